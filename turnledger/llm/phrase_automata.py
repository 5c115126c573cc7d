"""Removal of repeated passages, located by sharded Aho-Corasick automata.

A window is 20 consecutive words of one document. A word goes if a window covers it whose
word sequence also starts earlier (smaller document id, or same document and earlier start).

1. Anchors. Of the 16 five-word phrases in a window the one with the smallest hash is its
   anchor, so equal windows have equal anchors. Phrases that are an anchor at two places or
   more are counted over the corpus; the smallest document of each is its owner (by id, or
   by text hash where there is none).
2. Segments. Runs of windows with recurring anchors of one owner travel as text to the
   owner's shard, so a copied passage moves as one piece. All places of a window reach one
   shard, because its anchor decides the shard.
3. Automata. A shard works through its owners in pieces of bounded size: windows that occur
   twice there are confirmed by counting, compiled into an automaton over word numbers, and
   all segments are streamed through it. A match is a comparison of words, not of hashes. The
   earliest place of a window is kept and the words of its other places are marked.
4. Owners of very frequent anchors are split over several shards by document. Each then
   marks what repeats inside it, and passes the first place of every window on; those are
   merged by a 128-bit window hash, at most one row a window and shard.

Marked ranges return to the documents, which lose the words.

Defined cases: null is an empty text; rows without id come before all others; rows repeated
with id and text are one document (each row gets the same result); rows of one id with
different texts are ordered by a hash of the text; no limit on the length of texts or on
the number of occurrences; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.text_arrays import PLAIN, Words, chunked_words, grams, mix, split_words

WINDOW, PHRASE = 20, 5
#: An owner's anchors with more places than SPLIT_AT are split by document into about the
#: square root of their number of shards; PIECE_WORDS are compiled together.
SPLIT_AT, PIECE_WORDS = 1024, 250_000
_NO_ID = -(1 << 63)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, position of its anchor, hash at every position).

    Ties go to the leftmost phrase, so equal windows have their anchor at the same place.
    """
    n = len(words.start)
    values = np.full(n, _LAST, np.uint64)
    values[: max(0, n - PHRASE + 1)] = grams(words.hash, PHRASE)
    window_at = np.flatnonzero(np.arange(n) + WINDOW <= words.first[1:][words.row_of()]) if n else np.zeros(0, np.int64)
    width, best = WINDOW - PHRASE + 1, np.arange(n)
    step = 1
    while step < width:
        step_by = min(step, width - step)
        other = best[step_by:]
        mine = best[: n - step_by]
        better = values[other] < values[mine]
        best = np.concatenate([np.where(better, other, mine), best[n - step_by :]]) if n > step_by else best
        step += step_by
    return window_at, best[window_at], values


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, document (id and key) and number of places, for each anchor of each document."""
    for batch in batches:
        ids, keys = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
        for low, _, words in chunked_words(batch.column("text"), PLAIN, False):
            _, at, values = anchors(words)
            if not len(at):
                continue
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            row = np.searchsorted(words.first, at, "right") - 1
            found = values[at]
            order = np.lexsort((found, row))
            found, row = found[order], row[order]
            new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (row[1:] != row[:-1])]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found[new].view(np.int64)),
                    pa.array(ids[low + row[new]]),
                    pa.array(keys[low + row[new]]),
                    pa.array(np.diff(np.append(new, len(found))).astype(np.int32)),
                ],
                ["anchor", "doc", "key", "places"],
            )


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of windows whose anchors recur, by owner and shard."""
    before = None
    for batch in batches:
        # Rows repeated with id and text follow each other: one of them is enough.
        ids, keys = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
        again = np.concatenate([[before == (ids[0], keys[0])], (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1])]) if len(ids) else []
        if np.any(again):
            batch = batch.take(pa.array(np.flatnonzero(~again)))
            ids, keys = ids[~again], keys[~again]
        if not len(ids):
            continue
        before = ids[-1], keys[-1]
        lists = batch.column("known")
        known_at = lists.offsets.to_numpy()
        fields = lists.values
        k_anchor = fields.field("anchor").to_numpy().view(np.uint64)
        k_owner, k_split = fields.field("owner").to_numpy(), fields.field("split").to_numpy()
        for low, high, words in chunked_words(batch.column("text"), PLAIN, False):
            window, at, values = anchors(words)
            if not len(window):
                continue
            a, b = known_at[low], known_at[high]
            in_row = np.repeat(np.arange(high - low), np.diff(known_at[low : high + 1])).astype(np.uint64)
            # One key for (row, anchor): sort the known ones, look the windows' up.
            have = mix(k_anchor[a:b] + (in_row + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(have)
            have = have[order]
            row = np.searchsorted(words.first, window, "right") - 1
            want = mix(values[at] + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            place = np.minimum(np.searchsorted(have, want), len(have) - 1)
            hit = have[place] == want
            window, row, place = window[hit], row[hit], a + order[place[hit]]
            if not len(window):
                continue
            owner, split = k_owner[place], k_split[place]
            document = mix(ids[low + row].view(np.uint64) ^ mix(keys[low + row].view(np.uint64)))
            shard = np.where(split > 1, document % split.astype(np.uint64), 0).astype(np.int64)
            new = np.concatenate([[True], (np.diff(window) != 1) | (np.diff(row) != 0) | (np.diff(owner) != 0) | (np.diff(split) != 0)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(window)) - 1
            raw = words.data.tobytes()
            texts = [
                raw[s:e]
                for s, e in zip(words.start[window[first]].tolist(), words.end[window[last] + WINDOW - 1].tolist())
            ]
            r = row[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owner[first]),
                    pa.array(split[first]),
                    pa.array(shard[first]),
                    pa.array(ids[low + r]),
                    pa.array(keys[low + r]),
                    pa.array((window[first] - words.first[r]).astype(np.int64)),
                    pa.array(texts, pa.binary()),
                ],
                ["owner", "split", "shard", "doc", "key", "start", "words"],
            )


_MARKS = "doc bigint, key bigint, start bigint, n bigint, h1 bigint, h2 bigint"


def _marks(doc, key, start, n, h1=None, h2=None) -> pa.RecordBatch:
    empty = pa.nulls(len(doc), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc),
            pa.array(key),
            pa.array(start),
            pa.array(np.broadcast_to(n, len(doc)).astype(np.int64)),
            empty if h1 is None else pa.array(h1.view(np.int64)),
            empty if h2 is None else pa.array(h2.view(np.int64)),
        ],
        ["doc", "key", "start", "n", "h1", "h2"],
    )


def _runs(doc, key, start) -> pa.RecordBatch:
    """Windows (any order) as ranges of words."""
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    near = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (start[1:] - start[:-1] <= WINDOW)
    first = np.flatnonzero(np.concatenate([[True], ~near]))
    last = np.append(first[1:], len(doc)) - 1
    return _marks(doc[first], key[first], start[first], start[last] + WINDOW - start[first])


def _resolve(piece: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Marks of a piece: rows (owner, split, shard, doc, key, start, words) of whole shards."""
    number = defaultdict(count().__next__)
    tokens = [list(map(number.__getitem__, row[6].split())) for row in piece]
    length = np.array([len(t) for t in tokens])
    flat = np.fromiter((x for t in tokens for x in t), np.int64, int(length.sum()))
    base = np.cumsum(length) - length
    seg = np.repeat(np.arange(len(piece)), length)
    inside = np.flatnonzero(np.arange(len(flat)) + WINDOW <= (base + length)[seg])
    seg = seg[inside]
    doc = np.array([row[3] for row in piece], np.int64)
    key = np.array([row[4] for row in piece], np.int64)
    start = np.array([row[5] for row in piece], np.int64)

    # Confirm: window hashes that occur twice. Equal windows have equal hashes.
    hashes = grams(mix(flat.astype(np.uint64) + np.uint64(1)), WINDOW)[inside]
    _, at, back, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    phrases = at[times > 1]
    if len(phrases):
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        order = np.argsort(phrases)
        for n, p in enumerate(inside[phrases[order]].tolist()):
            machine.add_word(tuple(flat[p : p + WINDOW].tolist()), n)
        machine.make_automaton()
        # Stream only segments that hold a confirmed window; matches are exact.
        live = np.unique(seg[times[back] > 1])
        where, which = [], []
        for s in live.tolist():
            for end, n in machine.iter(tuple(tokens[s])):
                where.append(base[s] + end - WINDOW + 1)
                which.append(n)
        where, which = np.array(where, np.int64), np.array(which, np.int64)
        s = np.searchsorted(base, where, "right") - 1
        d, k, p = doc[s], key[s], start[s] + where - base[s]
        order = np.lexsort((p, k, d, which))
        d, k, p, which = d[order], k[order], p[order], which[order]
        lead = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        lead = np.repeat(lead, np.diff(np.append(lead, len(which))))
        later = (d != d[lead]) | (k != k[lead]) | (p != p[lead])
        if later.any():
            yield _runs(d[later], k[later], p[later])

    # First places of the windows of split owners go on to the merge.
    part = np.array([row[1] > 1 for row in piece])[seg]
    if part.any():
        d, k, p, h = doc[seg[part]], key[seg[part]], start[seg[part]] + inside[part] - base[seg[part]], hashes[part]
        order = np.lexsort((p, k, d, h))
        lead = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])]
        raw = b" ".join(number)
        one, two = split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), PLAIN, False, second=True)
        where = inside[part][lead]
        h1 = grams(one.hash[flat], WINDOW)[where]
        h2 = grams(two[flat], WINDOW)[where]
        yield _marks(d[lead], k[lead], p[lead], WINDOW, h1, h2)


def _shard_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece, words = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if words >= PIECE_WORDS and row[:3] != piece[-1][:3]:
                yield from _resolve(piece)
                piece, words = [], 0
            piece.append(row)
            words += row[6].count(b" ") + 1
    if piece:
        yield from _resolve(piece)


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document without its marked words."""
    for batch in batches:
        marks = batch.column("marks")
        kept_text, n_words, n_removed = [], [], []
        for text, ranges in zip(batch.column("text").cast(pa.binary()).to_pylist(), marks.to_pylist()):
            words = text.split()
            total = len(words)
            if ranges:
                gone = np.zeros(total, bool)
                for r in ranges:
                    gone[r["start"] : r["start"] + r["n"]] = True
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            kept_text.append(b" ".join(words))
            n_words.append(total)
            n_removed.append(total - len(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _stripped(batches):
        digests = [hashlib.sha256(t).hexdigest() for t in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def with_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, key and ``marks``: the ranges of words (start, n) that a window repeats.

    One plan: both joins take the texts from one exchange by document, which is an id and a
    hash of the text, so that many rows without id, or of one id, are not one key.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("doc"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("key", F.xxhash64("text"))
    places = rows.mapInArrow(_anchor_rows, "anchor bigint, doc bigint, key bigint, places int")
    recurring = (
        places.groupBy("anchor")
        .agg(F.sum("places").alias("_n"), F.min(F.when(F.col("doc") != _NO_ID, F.col("doc")).otherwise(F.col("key"))).alias("owner"))
        .filter("_n > 1")
        # Powers of two, so that neighbouring anchors of an owner rarely differ.
        .withColumn(
            "split",
            F.when(F.col("_n") <= SPLIT_AT, F.lit(1)).otherwise(F.pow(F.lit(2), F.round(F.log2(F.sqrt("_n"))))).cast("bigint"),
        )
        .drop("_n")
    )
    known = (
        places.select("anchor", "doc", "key")
        .join(recurring, "anchor")
        .groupBy("doc", "key")
        .agg(F.collect_set(F.struct("anchor", "owner", "split")).alias("known"))
    )
    segments = (
        rows.join(known, ["doc", "key"])
        .select("doc", "key", "text", "known")
        .mapInArrow(_segment_rows, "owner bigint, split bigint, shard bigint, doc bigint, key bigint, start bigint, words binary")
    )
    found = (
        segments.repartition("owner", "split", "shard")
        .sortWithinPartitions("owner", "split", "shard")
        .mapInArrow(_shard_marks, _MARKS)
    )
    # Places of one window from the shards of a split owner meet: all but the first are marked.
    merged = F.col("h1").isNotNull()
    groups = found.groupBy(
        merged.alias("merged"),
        F.coalesce("h1", F.xxhash64("doc", "key", "start")).alias("h1"),
        F.coalesce("h2", F.lit(0)).alias("h2"),
    ).agg(F.collect_list(F.struct("doc", "key", "start", "n")).alias("places"))
    later = F.when(F.col("merged"), F.filter("places", lambda x: x != F.array_min("places"))).otherwise(F.col("places"))
    marks = (
        groups.select(F.explode(later).alias("r"))
        .groupBy(F.col("r.doc").alias("doc"), F.col("r.key").alias("key"))
        .agg(F.collect_list(F.struct("r.start", "r.n")).alias("marks"))
    )
    return rows.join(marks, ["doc", "key"], "left").select(
        F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "text", "key", "marks"
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words that stay, joined by one space (UTF-8)."""
    return with_marks(docs, id_col, text_col).mapInArrow(_stripped, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return with_marks(docs, "doc_id", "text").mapInArrow(
        _digested, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    )


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1
),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, (SELECT unnest(range(0, 20)) AS j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
