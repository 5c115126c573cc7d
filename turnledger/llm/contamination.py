"""Benchmark decontamination: which documents contain a test item.

An item is contained where at least 0.8 of its distinct five-word shingles occur in the
document (A-Z as a-z; words are runs of letters and digits). MinHash compares sets of like
size only, so items are partitioned by their number of shingles, and for a partition of up to u
shingles a document is read as consecutive blocks of u shingles: an item then meets blocks
of its own size in a text of any length. The shares of the item in all the blocks it touches
sum to 0.8 of it, so with r = 1 and 128 functions the chance that no block shares a minimum
is below (1 - 0.2)**128 = 4e-13, however the item is cut or spread. Blocks are nested: the
minima of a partition are the pairwise minima of the one before. Every candidate is verified
on the shingles themselves.

Items are the query set: they are taken to the tasks in blocks of bounded size, as many as
there are. Defined cases: items and texts under five words (null: none) have no shingles and
never match; repeated rows each give their pairs; null ids are returned as they are; empty
tables give no pairs; extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.bagminhash import WORDS_SQL
from turnledger.llm.text_arrays import ALNUM, chunked_words, gram_positions, grams, split_words

CONTAINMENT, SIZE, FUNCTIONS, SMALLEST = 0.8, 5, 128, 16
BLOCK_BYTES = 4 << 20
_SLOT = 1 << 14
_FACTORS = (np.random.default_rng(20).integers(0, 1 << 31, FUNCTIONS, dtype=np.uint32) * 2 + 1).astype(np.uint32)

_PAIRS = "doc_id bigint, item_id bigint, item_shingles int, shared_shingles int, containment double"


def _tokens(words, row: int) -> list[bytes]:
    raw = words.data.tobytes() if not hasattr(words, "_raw") else words._raw
    words._raw = raw
    a, b = words.first[row], words.first[row + 1]
    return [raw[s:e].lower() for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist())]


def _shingle_set(tokens: list[bytes]) -> set[tuple[bytes, ...]]:
    return set(zip(*(tokens[i:] for i in range(SIZE)))) if len(tokens) >= SIZE else set()


class ItemIndex:
    """Signatures of a block of items, in partitions by size."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids, self.sets, self.levels = [], [], {}
        by_level: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item_id, text in rows:
            raw = (text or "").encode()
            words = split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM, True)
            found = _shingle_set(_tokens(words, 0))
            if not found:
                continue
            at, _ = gram_positions(words, SIZE)
            values = (grams(words.hash, SIZE)[at] >> np.uint64(32)).astype(np.uint32)
            level = max(0, int(np.ceil(np.log2(len(found) / SMALLEST))))
            by_level[level].append((len(self.ids), (values[None, :] * _FACTORS[:, None]).min(axis=1)))
            self.ids.append(item_id)
            self.sets.append(found)
        for level, found in by_level.items():
            minima = np.stack([m for _, m in found], axis=1)
            slots = np.zeros((FUNCTIONS, _SLOT), bool)
            slots[np.arange(FUNCTIONS)[:, None], minima & np.uint32(_SLOT - 1)] = True
            exact = defaultdict(set)
            for n, m in found:
                for k, v in enumerate(m.tolist()):
                    exact[k, v].add(n)
            self.levels[level] = (slots.ravel(), dict(exact))

    def candidates(self, words) -> set[tuple[int, int]]:
        """(row, item) pairs that share a minimum in some block."""
        at, row = gram_positions(words, SIZE)
        if not len(at) or not self.levels:
            return set()
        values = (grams(words.hash, SIZE)[at] >> np.uint64(32)).astype(np.uint32)
        place = at - words.first[row]
        first = np.flatnonzero(place % SMALLEST == 0)
        minima, scratch = np.empty((FUNCTIONS, len(first)), np.uint32), np.empty_like(values)
        for k in range(FUNCTIONS):
            np.multiply(values, _FACTORS[k], out=scratch)
            minima[k] = np.minimum.reduceat(scratch, first)
        block, of = place[first] // SMALLEST, row[first]
        found = set()
        for level in range(max(self.levels) + 1):
            if level:
                first = np.flatnonzero(block % 2 == 0)
                minima = np.minimum.reduceat(minima, first, axis=1)
                block, of = block[first] // 2, of[first]
            if level in self.levels:
                slots, exact = self.levels[level]
                hit = slots[(np.arange(FUNCTIONS, dtype=np.uint32) * _SLOT)[:, None] + (minima & np.uint32(_SLOT - 1))]
                ks, bs = np.nonzero(hit)
                for k, b, v in zip(ks.tolist(), bs.tolist(), minima[ks, bs].tolist()):
                    found.update((int(of[b]), n) for n in exact.get((k, v), ()))
        return found


def _found(index: ItemIndex, column, threshold: float) -> list[tuple]:
    """(row, item id, item shingles, shared shingles, share) of the items in a column's texts."""
    out = []
    for low, _, words in chunked_words(column, ALNUM, True):
        row, own = -1, set()
        for r, n in sorted(index.candidates(words)):
            if r != row:
                row, own = r, _shingle_set(_tokens(words, r))
            shared = len(index.sets[n] & own)
            if shared >= threshold * len(index.sets[n]) - 1e-9:
                out.append((low + r, index.ids[n], len(index.sets[n]), shared, shared / len(index.sets[n])))
    return out


def _searcher(items, threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items.value)
        for batch in batches:
            out = _found(index, batch.column("text"), threshold)
            if out:
                rows, ids, sizes, shared, share = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(ids, pa.int64()),
                        pa.array(sizes, pa.int32()),
                        pa.array(shared, pa.int32()),
                        pa.array(share, pa.float64()),
                    ],
                    ["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"],
                )

    return search


def _keeper(items, threshold: float, text: int):
    """Batches without the rows whose text contains an item."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items.value)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[f[0] for f in _found(index, batch.column(text), threshold)]] = False
            yield batch if clean.all() else batch.filter(pa.array(clean))

    return keep


def _item_blocks(items: DataFrame) -> Iterator:
    """The items as broadcast blocks of about ``BLOCK_BYTES``."""
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = 1 + 2 * int(size // BLOCK_BYTES)
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield items.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = CONTAINMENT
) -> DataFrame:
    """Every (document, item) pair with the item's shingles in the document."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for held in _item_blocks(items):
        found = texts.mapInArrow(_searcher(held, threshold), _PAIRS)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows whose text contains no item; each row is judged by itself, whatever its id."""
    at = docs.columns.index("text")
    for held in _item_blocks(items):
        docs = docs.mapInArrow(_keeper(held, threshold, at), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contained_items(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"),
        spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text"),
    )


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents) WHERE len(w) >= 5
),
b AS (
  SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) >= 5
),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM d),
bs AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM b),
sizes AS (SELECT item_id, count(*) AS n FROM bs GROUP BY ALL),
shared AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_shingles, CAST(k AS INTEGER) AS shared_shingles, k / n AS containment
FROM shared JOIN sizes USING (item_id) WHERE k >= {CONTAINMENT} * n - 1e-9
"""
