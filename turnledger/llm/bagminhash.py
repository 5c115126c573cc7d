"""Near-duplicate classes from BagMinHash signatures.

A text is the multiset of its five-word shingles (A-Z as a-z; words are runs of letters and
digits; a text of one to four words is one shingle). A shingle of weight w covers [0, w) of
a weight axis cut at 0, 1, 2, 4, 8, ...: each piece [v, 2v) carries one Poisson process in
time whose rate is its width, and each arrival has a register and a place in the piece.
Arrivals with a place below w count, so a heavy shingle costs one process for each doubling
of its weight, and two texts share all arrivals below the smaller weight. A register's value
is its first arrival: two texts agree in it with probability
sum(min weight) / sum(max weight), the weighted Jaccard similarity, without bias.

Texts are collapsed by digest first. In a bucket of a band every text meets the bucket's
leader only: the text with the smallest share of shingles that no other candidate has, which
in a group of edited copies is the original or near it. Pairs are verified on the exact
multisets; then texts of one bucket that are still in different classes meet each other. So a
group of n copies costs n pairs. A pair is left out only where it cannot pass: shingles
that occur in one text alone bound what two texts share, and a signature of 2048 registers, one
bit each, rules out pairs that differ in six deviations more bits than texts of the wanted
similarity do (chance of a wrong one below 1e-7, as that of a pair that no band catches).
Every other candidate pair is verified or already in one class.

Defined cases: null is an empty text; texts without words equal only the same text; rows
with equal texts (also repeated rows) share a class; rows without id are members but never
name a class unless all are without id; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.components import components
from turnledger.llm.stages import written
from turnledger.llm.text_arrays import ALNUM, chunked_words, mix, shingles

REGISTERS, BANDS = 128, 32
SIMILARITY = 0.8
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def weighted(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, row, weight) of the distinct values of each row, ordered by row and value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return values[at], rows[at], np.diff(np.append(at, len(values)))


def bag_signatures(values: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """First arrival time of every register of every row; inf where a row has no value."""
    levels = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))), 0).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(values)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    row, weight = rows[owner], weights[owner].astype(np.float64)
    seed = mix(mix(values[owner] ^ (level.astype(np.uint64) * _C3)))
    time = np.zeros(len(owner))
    table = np.full(n_rows * m, np.inf)
    step = 0
    while len(row):
        burst = int(max(1, min(256, 200_000 // len(row))))
        steps = np.arange(step, step + burst, dtype=np.uint64) + np.uint64(1)
        x = mix(seed[:, None] + steps[None, :] * _C2)
        gap = -np.log(((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width[:, None]
        # Added one after the other, so that times do not depend on how arrivals are batched.
        gap[:, 0] += time
        times = np.cumsum(gap, axis=1)
        y = mix(x + _C3)
        place = low[:, None] + width[:, None] * ((y >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        limit = table.reshape(n_rows, m).max(axis=1)[row]
        hit = (place < weight[:, None]) & (times < limit[:, None])
        register = (y & np.uint64(0x7FF)).astype(np.int64) % m
        np.minimum.at(table, ((row * m)[:, None] + register)[hit], times[hit])
        time = times[:, -1]
        step += burst
        alive = time < table.reshape(n_rows, m).max(axis=1)[row]
        row, weight, seed, time, low, width = (a[alive] for a in (row, weight, seed, time, low, width))
    return table.reshape(n_rows, m)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, m = signatures.shape
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(n, bands, m // bands)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _C1, (n, bands)).copy()
    for i in range(m // bands):
        keys = mix(keys + bits[:, :, i] * _C2 + np.uint64(i + 1))
    return keys.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, bands of each text that has words."""
    for batch in batches:
        for low, high, words in chunked_words(batch.column("text"), ALNUM, True):
            values, rows = shingles(words)
            has = np.flatnonzero(words.counts > 0)
            if not len(has):
                continue
            values, rows, weights = weighted(values, rows)
            keys = band_keys(bag_signatures(values, np.searchsorted(has, rows), weights, len(has)))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(low, high - low).take(pa.array(has)), lists], ["key", "bands"])


def _bags(column) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _, _, words in chunked_words(column, ALNUM, True):
        values, rows, weights = weighted(*shingles(words))
        cut = np.searchsorted(rows, np.arange(words.rows + 1))
        out += [(values[a:b], weights[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return out


def multiset_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def _verifier(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows of one leader stand together, so its bag is made once for each run.
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                left = part.column("a").to_pylist()
                runs = [i for i in range(len(left)) if i == 0 or left[i] != left[i - 1]]
                firsts = _bags(part.column("text_a").take(pa.array(runs)))
                seconds = _bags(part.column("text_b"))
                run = -1
                scores = []
                for i in range(len(left)):
                    run += run + 1 < len(runs) and runs[run + 1] == i
                    scores.append(multiset_similarity(firsts[run], seconds[i]))
                keep = pa.array([i for i, s in enumerate(scores) if s >= threshold], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").take(keep), part.column("b").take(keep), pa.array(scores, pa.float64()).take(keep)],
                    ["a", "b", "similarity"],
                )

    return verify


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of text keys whose multisets overlap enough."""
    both = (
        pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "text_a", "b", "text_b")
    )
    return both.mapInArrow(_verifier(threshold), "a binary, b binary, similarity double")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, id, w, n) of every shingle of a text, and a row of its own with its total n."""
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for low, high, words in chunked_words(batch.column("text"), ALNUM, True):
            values, rows, weights = weighted(*shingles(words))
            own = ids[low:high]
            total = np.bincount(rows, weights=weights, minlength=high - low).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([values, mix(own.view(np.uint64) ^ _C2)]).view(np.int64)),
                    pa.array(np.concatenate([own[rows], own])),
                    pa.array(np.concatenate([weights, np.zeros(len(own), np.int64)])),
                    pa.array(np.concatenate([np.zeros(len(rows), np.int64), total])),
                ],
                ["h", "id", "w", "n"],
            )


def own_shingles(texts: DataFrame) -> DataFrame:
    """(key, n, own): shingles of each text, and how many of them no other of the texts has.

    A shingle of one text names that text as its smallest, so no row meets its count again.
    """
    rows = texts.select(F.xxhash64("key").alias("id"), "text").mapInArrow(_shingle_rows, "h bigint, id bigint, w bigint, n bigint")
    single = (
        rows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("id").alias("id"), F.sum("w").alias("w"), F.sum("n").alias("n"))
        .filter("_c = 1")
    )
    sums = single.groupBy("id").agg(F.sum("n").alias("n"), F.sum("w").alias("own"))
    return texts.select("key", F.xxhash64("key").alias("id")).join(sums, "id").drop("id")


SKETCH = 2048


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, sketch: one bit of each of 2048 registers, as longs."""
    for batch in batches:
        for low, high, words in chunked_words(batch.column("text"), ALNUM, True):
            values, rows, weights = weighted(*shingles(words))
            has = np.flatnonzero(words.counts > 0)
            table = bag_signatures(values, np.searchsorted(has, rows), weights, len(has), SKETCH)
            bits = (mix(np.ascontiguousarray(table).view(np.uint64).ravel()) & np.uint64(1)).astype(np.uint8)
            longs = np.packbits(bits.reshape(len(has), SKETCH), axis=1).view(np.int64)
            width = SKETCH // 64
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * width), pa.array(longs.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(low, high - low).take(pa.array(has)), lists], ["key", "sketch"])


def _alike(a, b, threshold: float):
    """Whether two sketches may belong to texts of the wanted similarity: bits differ with
    probability (1 - similarity) / 2."""
    p = (1 - threshold) / 2
    most = int(SKETCH * p + 6 * (SKETCH * p * (1 - p)) ** 0.5)
    differ = F.lit(0)
    for i in range(SKETCH // 64):
        differ = differ + F.bit_count(a[i].bitwiseXOR(b[i]))
    return differ <= most


def _can_pass(n_a, own_a, n_b, own_b, threshold: float):
    """Whether two texts can share enough without the shingles that each has alone."""
    most = F.least(n_a - own_a, n_b - own_b)
    return most >= threshold * (n_a + n_b - most) - 1e-9


def crossed_pairs(apart: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of texts of one band and different classes that can pass, each pair once.

    ``apart``: band, key, n, own, class, sketch. A pair that shares several bands is met in the
    least of them only.
    """
    bands = apart.groupBy("key").agg(F.collect_set("band").alias("bands"))
    apart = apart.join(bands, "key")
    x = apart.select("band", F.col("key").alias("a"), F.col("class").alias("_ca"), F.col("n").alias("_na"), F.col("own").alias("_oa"), F.col("sketch").alias("_sa"), F.col("bands").alias("_ba"))
    y = apart.select("band", F.col("key").alias("b"), F.col("class").alias("_cb"), F.col("n").alias("_nb"), F.col("own").alias("_ob"), F.col("sketch").alias("_sb"), F.col("bands").alias("_bb"))
    return (
        x.join(y, "band")
        .filter("_ca <> _cb and a < b")
        .filter(_can_pass(F.col("_na"), F.col("_oa"), F.col("_nb"), F.col("_ob"), threshold))
        .filter(_alike(F.col("_sa"), F.col("_sb"), threshold))
        .filter(F.array_min(F.array_intersect("_ba", "_bb")) == F.col("band"))
        .select("a", "b")
    )


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def text_classes(keyed: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(key, class) of every text of ``keyed`` (key, text) that resembles another one."""
    signed = keyed.select("key", "text").mapInArrow(_signed, "key binary, bands array<bigint>").dropDuplicates(["key"])
    placed = signed.select("key", F.explode("bands").alias("band"))
    full = placed.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("band")
    places = written(placed.join(full, "band"), "near_places")
    texts = written(
        keyed.select("key", "text")
        .join(places.select("key").distinct(), "key", "left_semi")
        .groupBy("key")
        .agg(F.first("text").alias("text")),
        "near_texts",
    )
    members = written(places.join(own_shingles(texts), "key"), "near_members")
    leaders = members.groupBy("band").agg(F.min_by(F.struct("key", "n", "own"), F.struct(F.col("own") / F.col("n"), "key")).alias("leader"))
    stars = written(
        members.join(leaders, "band")
        .filter(F.col("key") != F.col("leader.key"))
        .filter(_can_pass(F.col("n"), F.col("own"), F.col("leader.n"), F.col("leader.own"), threshold))
        .select(F.col("leader.key").alias("a"), F.col("key").alias("b"))
        .distinct(),
        "near_stars",
    )
    links = written(verified(stars, texts, threshold), "near_links")
    classes = components(links)

    # Texts of one bucket that the leader left in different classes.
    here = members.join(classes, "key", "left").select("band", "key", "n", "own", F.coalesce("class", "key").alias("class"))
    mixed = here.groupBy("band").agg(F.min("class").alias("_x"), F.max("class").alias("_y")).filter("_x <> _y").select("band")
    apart = written(here.join(mixed, "band"), "near_apart")
    drawn = texts.join(apart.select("key").distinct(), "key", "left_semi").mapInArrow(_sketches, "key binary, sketch array<bigint>")
    apart = apart.join(written(drawn, "near_sketches"), "key")
    crossed = crossed_pairs(apart, threshold)
    more = written(verified(crossed, texts, threshold), "near_more")
    if more.limit(1).count():
        classes = components(links.unionByName(more))
    return classes


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: its id, class_id (smallest id of the class), class_size."""
    keyed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        _text_key(text_col).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    classes = text_classes(keyed, threshold)
    member = keyed.select("doc_id", "key").join(classes, "key", "left")
    member = member.select("doc_id", "key", F.coalesce("class", "key").alias("class"))
    named = member.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return member.join(named, "class").select("doc_id", "class_id", "class_size")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the smallest id, of one id that with the smallest
    digest of its text. Rows are told apart by id and text, so a row never goes for another
    one of its id; rows equal in both are one document, and rows without id are kept."""
    key = next(n for i in range(len(docs.columns) + 1) if (n := f"_key{i}") not in docs.columns)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    classes = text_classes(keyed)
    member = keyed.select("doc_id", "key").where("doc_id is not null").join(classes, "key", "left")
    member = written(member.select("doc_id", "key", F.coalesce("class", "key").alias("class")).distinct(), "near_members")
    first = member.groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    gone = member.join(first, "class").where(F.struct("doc_id", "key") != F.col("first")).select("doc_id", F.col("key").alias(key))
    left = docs.withColumn(key, _text_key("text")).join(gone, ["doc_id", key], "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


#: Shared by the queries on shingles: words are runs of ASCII letters, digits and all else
#: beyond ASCII, with A-Z as a-z.
WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')"""

OP10_SQL = f"""
WITH RECURSIVE toks AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM toks
),
bags AS (SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s, count(*) AS n FROM starts GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) AS total FROM bags GROUP BY ALL),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS s
  FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE s / (p.total + q.total - s) >= {SIMILARITY}
  UNION
  SELECT a.doc_id, b.doc_id FROM toks a JOIN toks b ON a.text = b.text AND a.doc_id < b.doc_id
),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x
)
SELECT x AS doc_id, min(y) AS class_id, count(*) AS class_size FROM reach GROUP BY x
"""
