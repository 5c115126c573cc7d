"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

A count c is stored as its level q = 1 + floor(log(c) / log(1.5)): the n-gram is inserted
under (n-gram, 1) ... (n-gram, q), and its count is read back by probing level 1, 2, ...
until one is absent. Two filters hold words and word pairs; a token's probability is
``PAIR_SHARE`` of its share after the word before and the rest of its add-one share of all
tokens, both read from the filters. A filter is dealt into parts by the key's hash; a part
is filled by one task, with the size that its own n-grams need, and stays a row of a table.
All n-grams of the training rows are stored, and the filters grow with them.

Scoring brings the probes to the parts: a task numbers the distinct n-grams of ``ASKED``
tokens and sends them to their parts, each part answers with levels, and the answers meet the
tokens again under the number of their chunk. Neither the driver nor a task holds a filter.

The base score needs exact counts of all words, which have no bound: about ``FREQUENT`` most
frequent words go to the tasks, and all other words meet their counts in a join by hash, one
row a document and word. Words are told apart by 64-bit hashes.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z, then one end token a document.

Defined cases: null is an empty text (one token, the end); rows without id count as
training; rows that repeat with id and text each get the same result; rows of one id with
different texts are scored apart; without training rows every count is 0; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.stages import written
from turnledger.llm.text_arrays import PLAIN, Words, chunked_words, mix

BASE, MAX_LEVEL, PROBES, BITS_PER_LEVEL = 1.5, 64, 5, 10
PAIR_SHARE = 0.4
FREQUENT = 1 << 18
#: Tokens that a task counts before it passes them on, and tokens a part of the pairs is made for.
FLUSH, PART_TOKENS = 2_000_000, 1 << 21
#: Tokens that a task scores together, and keys that are hashed together.
ASKED, SLICE = 1 << 20, 1 << 17
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
END = np.uint64(0x5851F42D4C957F2D)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)
_LOW40 = np.uint64((1 << 40) - 1)


def token_stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the rows, each closed by END, and the offsets of the rows."""
    first = np.concatenate([[0], np.cumsum(words.counts + 1)])
    out = np.empty(first[-1], np.uint64)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = words.hash
    out[~keep] = END
    return out, first


def pair_hashes(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of (token before, token) for every token; before a document stands END."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = END
    return mix(before * _C1 + tokens)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(MAX_LEVEL, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9)).astype(np.int64)


_LOW = np.ceil(BASE ** np.arange(0, MAX_LEVEL + 1) - 1e-9)
_MIDDLE = np.concatenate([[0.0], (_LOW[:-1] + np.maximum(_LOW[1:] - 1, _LOW[:-1])) / 2])


def _probes(keys: np.ndarray, level, bits: int) -> np.ndarray:
    seed = mix(keys + np.asarray(level, np.uint64) * _C2)
    step = mix(seed + _C1) | np.uint64(1)
    return ((seed[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


@dataclass
class CountFilter:
    """Parts of equal size; a key's part is the top ``shift`` bits of its hash."""

    bits: np.ndarray
    shift: int
    part_bytes: int

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.shift)).astype(np.int64) if self.shift else np.zeros(len(keys), np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Stored level of each key, 0 if absent."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.bits):
            return out
        live, base = np.arange(len(keys)), self.part(keys) * self.part_bytes * 8
        short = keys & _LOW40
        for q in range(1, MAX_LEVEL + 1):
            at = _probes(short[live], q, self.part_bytes * 8) + base[live, None]
            there = ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            live = live[there]
            if not len(live):
                break
            out[live] = q
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Stored count of each key (the middle of its level), 0 if absent."""
        return _MIDDLE[self.levels(keys)]


def fill_part(keys: np.ndarray, levels: np.ndarray, part_bytes: int) -> bytes:
    """One part of a filter from its keys (low 40 bits of the hashes)."""
    marks = np.zeros(part_bytes * 8, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        found = keys[levels >= q]
        for low in range(0, len(found), SLICE):
            marks[_probes(found[low : low + SLICE], q, part_bytes * 8).ravel()] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _pack(keys: np.ndarray, counts: np.ndarray, shift: int) -> pa.RecordBatch:
    """Sorted keys as one row a part: five bytes a key, one a count (255: see ``large``)."""
    part = (keys >> np.uint64(64 - shift)).astype(np.int64) if shift else np.zeros(len(keys), np.int64)
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    cut = np.append(edge, len(keys))
    low = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5]
    small, big = np.minimum(counts, 255).astype(np.uint8), counts >= 255
    rows = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[edge]),
            pa.array([low[a:b].tobytes() for a, b in rows], pa.binary()),
            pa.array([small[a:b].tobytes() for a, b in rows], pa.binary()),
            pa.array([counts[a:b][big[a:b]].astype(np.int64).tobytes() for a, b in rows], pa.binary()),
        ],
        ["part", "keys", "small", "large"],
    )


def _unpack(keys: bytes, small: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray]:
    five = np.frombuffer(keys, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(five), 8), np.uint8)
    wide[:, :5] = five
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, np.int64)
    return wide.view(np.uint64).ravel(), counts


_PACKED = "part bigint, keys binary, small binary, large binary"


def _counting(of, emit):
    """mapInArrow function: ``of(words)`` arrays, counted within the task, as ``emit(values, counts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, words in chunked_words(batch.column("text"), PLAIN, True):
                held.append(of(words))
                size += len(held[-1])
                if size >= FLUSH:
                    yield emit(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if size:
            yield emit(*np.unique(np.concatenate(held), return_counts=True))

    return run


def _word_rows(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "n"])


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter of each part, from packed rows in order of part."""
    part, held = None, []

    def done():
        keys = np.concatenate([k for k, _ in held])
        counts = np.concatenate([c for _, c in held])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        levels = level_of(np.add.reduceat(counts, edge))
        size = max(64, int(levels.sum()) * BITS_PER_LEVEL // 8 + 1)
        bits = fill_part(keys[edge], levels, size)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([bits], pa.binary())], ["part", "bits"])

    for batch in batches:
        for p, keys, small, large in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part and held:
                yield done()
                held = []
            part = p
            held.append(_unpack(keys, small, large))
    if held:
        yield done()


def _written_once(df: DataFrame, name: str) -> DataFrame:
    """The written table; the shuffle files of its plan, read once, go with the write."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(_CLEANUP, before)


def _filters(packed: DataFrame, name: str) -> DataFrame:
    """The written filter of packed rows, one row a part."""
    dealt = packed.repartition("part").sortWithinPartitions("part")
    return _written_once(dealt.mapInArrow(_merge_parts, "part bigint, bits binary"), name)


@dataclass
class Totals:
    """What every task needs to know of the training rows."""

    tokens: int
    kinds: int
    word_shift: int
    pair_shift: int
    frequent: np.ndarray  # sorted hashes of the most frequent words
    frequent_counts: np.ndarray


@dataclass
class Model:
    totals: Totals
    words: DataFrame  # part, bits
    pairs: DataFrame

    @property
    def tokens(self) -> int:
        return self.totals.tokens

    @property
    def kinds(self) -> int:
        return self.totals.kinds


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all ``texts`` (column text) and the table of exact word counts (h, n)."""
    shift_of = lambda n: max(0, min(20, int(np.ceil(np.log2(max(1, n) / PART_TOKENS)))))
    vocabulary = written(
        texts.mapInArrow(_counting(lambda w: token_stream(w)[0], _word_rows), "h bigint, n bigint")
        .groupBy("h")
        .agg(F.sum("n").alias("n")),
        "words",
    )
    total = vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, kinds = total[0] or 0, total[1]

    # The most frequent words, by the smallest eighth of a doubling of which few enough have more.
    step = F.floor(F.log2("n") * 8).cast("int")
    cut, left = 1 << 30, FREQUENT
    for row in vocabulary.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        left -= row["count"]
        if left < 0:
            break
        cut = row["s"]
    top = vocabulary.filter(step >= cut).toArrow()
    hashes, counts = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(hashes)

    shift = shift_of(tokens)
    packed = texts.mapInArrow(_counting(lambda w: pair_hashes(*token_stream(w)), lambda k, n: _pack(k, n, shift)), _PACKED)
    pairs = _filters(packed, "pairs")
    word_shift = shift_of(8 * kinds)

    def word_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix(batch.column("h").to_numpy().view(np.uint64))
            order = np.argsort(keys)
            if len(keys):
                yield _pack(keys[order], batch.column("n").to_numpy()[order], word_shift)

    words = _filters(vocabulary.mapInArrow(word_parts, _PACKED), "word_parts")
    return Model(Totals(tokens, kinds, word_shift, shift, hashes[order], counts[order]), words, pairs), vocabulary


# Rows on the way to the filters and back: the tokens of a chunk, its probes (or the answers) at
# one part of a filter, and a part of a filter, which has no chunk.
_TOKENS, _WORDS, _PAIRS = 0, 1, 2
_ASKED = "chunk bigint, kind int, part bigint, data binary"


def _asked_rows(chunk, kinds, parts, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(kinds), pa.int64()), pa.array(kinds, pa.int32()), pa.array(parts, pa.int64()), pa.array(data, pa.binary())],
        ["chunk", "kind", "part", "data"],
    )


def _by_frequency(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens, most frequent first, and the place of each token among them."""
    kinds, codes, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(kinds), np.uint32)
    place[order] = np.arange(len(kinds), dtype=np.uint32)
    return kinds[order], place[codes]


def _chunk_bytes(uid: np.ndarray, lengths: np.ndarray, kinds: np.ndarray, codes: np.ndarray) -> bytes:
    """A chunk's rows and tokens. Codes by frequency have upper bytes that are mostly zero, so
    they are packed byte by byte of the number: about half of the room of three bytes a token."""
    planes = np.ascontiguousarray(codes.astype("<u4")).view(np.uint8).reshape(-1, 4)
    packed = [pa.compress(np.ascontiguousarray(planes[:, i]).tobytes(), codec="zstd", asbytes=True) for i in range(4)]
    packed.append(pa.compress(lengths.astype("<i8").tobytes(), codec="zstd", asbytes=True))
    head = np.array([len(uid), len(kinds), len(codes), *map(len, packed)], np.int64)
    return b"".join([head.tobytes(), uid.tobytes(), kinds.tobytes(), *packed])


def _chunk_parts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """uid, offsets of the rows, kinds and codes of ``_chunk_bytes``."""
    n, m, tokens, *sizes = np.frombuffer(data, np.int64, 8).tolist()
    uid, kinds = np.frombuffer(data, np.int64, n, 64), np.frombuffer(data, np.uint64, m, 64 + 8 * n)
    planes, at = np.empty((tokens, 4), np.uint8), 64 + 8 * (n + m)
    for i, size in enumerate(sizes[:4]):
        planes[:, i] = np.frombuffer(pa.decompress(data[at : at + size], tokens, codec="zstd", asbytes=True), np.uint8)
        at += size
    lengths = np.frombuffer(pa.decompress(data[at : at + sizes[4]], 8 * n, codec="zstd", asbytes=True), np.int64)
    return uid, np.concatenate([[0], np.cumsum(lengths)]), kinds, planes.view("<u4").ravel().astype(np.int64)


def _asking(shared):
    def chunk_rows(held: list, place: str) -> pa.RecordBatch:
        tokens = np.concatenate([t for _, t, _ in held])
        lengths = np.concatenate([np.diff(f) for _, _, f in held])
        first = np.concatenate([[0], np.cumsum(lengths)])
        kinds, codes = _by_frequency(tokens)
        uid = np.concatenate([u for u, _, _ in held])
        rows = [(_TOKENS, 0, _chunk_bytes(uid, lengths, kinds, codes))]
        for kind, shift, keys in (
            (_WORDS, shared.value.word_shift, np.sort(mix(kinds))),
            (_PAIRS, shared.value.pair_shift, np.unique(pair_hashes(tokens, first))),
        ):
            part = (keys >> np.uint64(64 - shift)).astype(np.int64) if shift else np.zeros(len(keys), np.int64)
            low = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            rows += [(kind, int(part[a]), low[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
        # A task that runs again gives the same numbers only to the same chunks.
        name = hashlib.blake2b(rows[0][2], digest_size=8, salt=place.encode())
        chunk = int.from_bytes(name.digest(), "little", signed=True)
        rows[0] = (_TOKENS, chunk, rows[0][2])
        return _asked_rows(chunk, *zip(*rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with the tokens of each chunk, and its distinct n-grams, one row a part."""
        held, size, done, task = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for low, high, words in chunked_words(batch.column("text"), PLAIN, True):
                held.append((uid[low:high], *token_stream(words)))
                size += len(held[-1][1])
                if size >= ASKED:
                    yield chunk_rows(held, f"{task:x},{done:x}")
                    held, size, done = [], 0, done + 1
        if held:
            yield chunk_rows(held, f"{task:x},{done:x}")

    return run


def _answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of all probes, from rows in order of part, a part before its probes."""
    at, part = None, None
    for batch in batches:
        for chunk, kind, p, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "part", "data"))):
            if kind == _TOKENS:
                yield _asked_rows(chunk, [kind], [p], [data])
                continue
            if chunk is None:
                at, part = (kind, p), CountFilter(np.frombuffer(data, np.uint8), 0, len(data))
                continue
            keys = _unpack(data, bytes(len(data) // 5), b"")[0]
            levels = np.zeros(len(keys), np.uint8)
            if at == (kind, p):
                for low in range(0, len(keys), SLICE):
                    levels[low : low + SLICE] = part.levels(keys[low : low + SLICE])
            yield _asked_rows(chunk, [kind], [p], [levels.tobytes()])


def _chunk_scores(totals: Totals, data: bytes, levels: dict[int, list[bytes]]) -> pa.RecordBatch:
    """uid and score of the rows of a chunk; ``levels`` in the order of the keys."""
    uid, first, kinds, back = _chunk_parts(data)
    words, pairs = (np.frombuffer(b"".join(levels[k]), np.uint8) for k in (_WORDS, _PAIRS))
    found, pair_back = np.unique(pair_hashes(kinds[back], first), return_inverse=True)
    if (len(words), len(pairs)) != (len(kinds), len(found)):
        raise ValueError("answers of the filters do not match the tokens of a chunk")
    count = np.zeros(len(kinds))
    count[np.argsort(mix(kinds))] = _MIDDLE[words]
    together = _MIDDLE[pairs][pair_back]
    before = np.empty(len(back), np.int64)
    before[1:] = back[:-1]
    before[first[:-1]] = np.flatnonzero(kinds == END)[0]
    word = np.minimum(1.0, (count[back] + 1.0) / (totals.tokens + totals.kinds + 1.0))
    seen = count[before]
    share = np.minimum(together, seen) / np.maximum(seen, 1.0)
    logs = np.log10(PAIR_SHARE * share + (1 - PAIR_SHARE) * word)
    return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(np.add.reduceat(logs, first[:-1]))], ["uid", "score"])


def _closing(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The scores, from rows in order of chunk, kind and part."""
        at, data, levels = None, None, {}
        for batch in batches:
            for chunk, kind, row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "data"))):
                if kind == _TOKENS:
                    if data is not None:
                        yield _chunk_scores(shared.value, data, levels)
                    at, data, levels = chunk, row, {_WORDS: [], _PAIRS: []}
                elif chunk != at:
                    raise ValueError("answers of the filters without the tokens of their chunk")
                else:
                    levels[kind].append(row)
        if data is not None:
            yield _chunk_scores(shared.value, data, levels)

    return run


def _filter_scores(rows: DataFrame, model: Model, shared) -> DataFrame:
    """uid and score of all rows (uid, text)."""
    met = rows.mapInArrow(_asking(shared), _ASKED)
    for kind, table in ((_WORDS, model.words), (_PAIRS, model.pairs)):
        met = met.unionByName(table.select(F.lit(None).cast("bigint").alias("chunk"), F.lit(kind).alias("kind"), "part", F.col("bits").alias("data")))
    met = met.repartition("kind", "part").sortWithinPartitions("kind", "part", F.asc_nulls_first("chunk"))
    back = met.mapInArrow(_answering, _ASKED).repartition("chunk").sortWithinPartitions("chunk", "kind", "part")
    return _written_once(back.mapInArrow(_closing(shared), "uid bigint, score double"), "filter_scores")


def _scoring(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document with what is known here, and a row for each of its rare words."""
        model: Totals = shared.value
        unit = model.tokens + model.kinds + 1.0
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for low, high, words in chunked_words(batch.column("text"), PLAIN, True):
                tokens, first = token_stream(words)
                at = np.searchsorted(model.frequent, tokens)
                common = np.zeros(len(tokens), bool)
                inside = at < len(model.frequent)
                common[inside] = model.frequent[at[inside]] == tokens[inside]
                base = np.zeros(len(tokens))
                base[common] = np.log10((model.frequent_counts[at[common]] + 1.0) / unit)
                row = np.repeat(np.arange(high - low), np.diff(first))
                rare, rare_row = tokens[~common], row[~common]
                order = np.lexsort((rare, rare_row))
                rare, rare_row = rare[order], rare_row[order]
                edge = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])])) if len(rare) else np.zeros(0, np.int64)
                own = uid[low:high]
                sums = [
                    np.diff(first),
                    np.add.reduceat(common.astype(np.int64), first[:-1]),
                    np.add.reduceat(base, first[:-1]),
                ]
                n = len(own)
                known = pa.StructArray.from_arrays([pa.array(x) for x in sums], ["n_tokens", "n_known", "base"])
                nulls = pa.nulls(len(edge), known.type)
                yield pa.RecordBatch.from_arrays(
                    [
                        # Documents are dealt like words, under hashes that no sum uses.
                        pa.array(np.concatenate([mix(own.view(np.uint64)), rare[edge]]).view(np.int64)),
                        pa.array(np.concatenate([own, own[rare_row[edge]]])),
                        pa.array(np.concatenate([np.zeros(n, np.int64), np.diff(np.append(edge, len(rare)))])),
                        pa.concat_arrays([known, nulls]),
                    ],
                    ["h", "uid", "n", "own"],
                )

    return run


_SCORED = "h bigint, uid bigint, n bigint, own struct<n_tokens: bigint, n_known: bigint, base: double>"


def scores(docs: DataFrame, model: Model, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit(""))).alias("uid"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model.totals)
    parts = rows.select("uid", "text").mapInArrow(_scoring(shared), _SCORED)
    counts = vocabulary.select("h", F.col("n").alias("c"))
    met = parts.join(counts, "h", "left").select("uid", "n", "c", "own", F.lit(None).cast("double").alias("score"))
    met = met.unionByName(_filter_scores(rows.select("uid", "text"), model, shared), allowMissingColumns=True)
    rare = F.col("own").isNull() & F.col("n").isNotNull()
    unit = float(model.tokens + model.kinds + 1)
    sums = met.groupBy("uid").agg(
        F.first("own", ignorenulls=True).alias("own"),
        F.first("score", ignorenulls=True).alias("score"),
        F.count("own").alias("m"),
        F.sum(F.when(rare, F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(unit))).otherwise(0.0)).alias("base"),
        F.sum(F.when(rare & (F.col("c") > 0), F.col("n")).otherwise(0)).alias("known"),
    )
    # Rows repeated with id and text have one uid: each adds its rare words once more.
    ids = rows.select("uid", "doc_id")
    return ids.join(sums, "uid").select(
        "doc_id",
        F.col("own.n_tokens").alias("n_tokens"),
        (F.col("own.n_known") + (F.col("known") / F.col("m")).cast("bigint")).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("own.base") + F.col("base") / F.col("m")).alias("base_score"),
        "score",
    )


def op9_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model, vocabulary = train(docs.filter(~held_out).select("text"))
    return scores(docs, model, vocabulary).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
