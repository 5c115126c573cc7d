"""Exact BM25 top-k that skips ranges of documents by block maxima.

The documents of a scope are cut into ranges of about ``RANGE`` by their first floor, and
the postings of a term in one range are a block. A block keeps its largest term frequency
and its smallest document length, which bound what it can add to a score whatever the
average length of the scope becomes. The bounds of a query's terms, summed over a range,
bound every document in it:

1. The ranges with the largest bounds of a query are scored; its k-th best score there is
   the threshold.
2. Ranges whose bound is below the threshold cannot hold one of the k best, ties included,
   and their blocks are not read. All others are scored in full.

Document frequencies are sums over the blocks, so postings are only read for scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.operators.bm25 import (
    DEFAULT_TOP_K,
    SCORE_DIGITS,
    build_index,
    by_score,
    corpus_stats,
    index_rows,
    query_terms,
    split_index,
    staged,
)
from turnledger.operators.ranking import positive_or, top_k
from turnledger.operators.scoring import B, K1, SCOPE, Asked, Best, add_up, ask, idf, matched, term_weights

RANGE = 64
#: Ranges of a query that are scored for its threshold.
FIRST = 4
#: Sums of the same terms in another order differ by less than this share.
_SLACK = 1e-9
#: Scores that are equal once rounded differ by no more than this.
_TIE = 10.0**-SCORE_DIGITS

_BLOCK = [*SCOPE, "term", "range"]
_ASKED = [*SCOPE, "query_id", "range"]


def with_ranges(rows: DataFrame, documents: DataFrame, size: int = RANGE) -> DataFrame:
    """``rows`` (scope, start_floor) with ``range``: about ``size`` documents of a scope each, equally
    wide in floors, so that no scope is sorted. Documents of one floor share a range."""
    scopes = documents.groupBy(*SCOPE).agg(
        F.min("start_floor").alias("_low"),
        F.greatest(
            F.lit(1.0), (F.max("start_floor") - F.min("start_floor") + 1) * F.lit(float(size)) / F.count(F.lit(1))
        ).alias("_width"),
    )
    return (
        rows.join(scopes, SCOPE)
        .withColumn("range", F.floor((F.col("start_floor") - F.col("_low")) / F.col("_width")).cast("bigint"))
        .drop("_low", "_width")
    )


def build_blocks(
    memories: DataFrame, size: int = RANGE, written: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Postings with their range, and document lengths, ready to be written.

    ``block_maxima`` of the written postings is the third table of the index. ``written`` writes a
    table and reads it back: texts are then read once, and dealt by range, so that the postings
    of a block lie together.
    """
    if written is None:
        postings, lengths = build_index(memories)
        return with_ranges(postings, lengths, size), lengths
    ranged = with_ranges(memories, memories.filter(~F.col("stale")), size)
    return split_index(written(index_rows(ranged, ["range"], ["range"])))


def block_maxima(postings: DataFrame) -> DataFrame:
    """(scope, term, range): postings, largest frequency and smallest document length."""
    return postings.groupBy(*_BLOCK).agg(
        F.count(F.lit(1)).alias("postings"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length")
    )


def _part(tf: str, length: str) -> Column:
    """What a term adds to a score: larger with its frequency, smaller with the length."""
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col(length) / F.col("avg_length"))
    return F.col("idf") * (F.col(tf) * F.lit(K1 + 1) / (F.col(tf) + norm))


def _asked_blocks(blocks: DataFrame, stats: DataFrame, queries: DataFrame) -> DataFrame:
    """Blocks of the terms of each query, with what a posting's score needs and its bound."""
    terms = query_terms(queries)
    frequency = (
        blocks.join(terms.select(*SCOPE, "term").distinct(), [*SCOPE, "term"], "left_semi")
        .groupBy(*SCOPE, "term")
        .agg(F.sum("postings").alias("df"))
    )
    weights = terms.join(frequency, [*SCOPE, "term"]).join(stats, SCOPE)
    weights = weights.select(*SCOPE, "term", "query_id", "avg_length", idf(F.col("doc_count"), F.col("df")).alias("idf"))
    return blocks.join(weights, [*SCOPE, "term"]).select(
        *_BLOCK, "query_id", "avg_length", "idf", "postings", _part("max_tf", "min_length").alias("bound")
    )


def _needed_ranges(
    postings: DataFrame, blocks: DataFrame, stats: DataFrame, asked: Asked, k: int, first: int
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(scope, query_id, range, _q) that may hold one of a query's k best documents, and how the
    documents of such ranges are scored.

    Bounds are sums over the asked blocks of a range as scores are over the postings of a
    document, and are added up the same way (see ``scoring``).
    """
    held = matched(blocks, asked)
    weights = term_weights(held.groupBy(*SCOPE, "_t").agg(F.sum("postings").alias("df")), stats, asked)
    bounds = staged(add_up(held, asked, weights, ["range"], "max_tf", "min_length").withColumnRenamed("score", "_bound"), "bounds")

    def scored(ranges: DataFrame) -> DataFrame:
        place = [*SCOPE, "range"]
        only = ranges.groupBy(*place).agg(F.collect_list("_q").alias("_queries"))
        read = matched(postings.join(ranges.select(*place).distinct(), place, "left_semi"), asked)
        return add_up(read, asked, weights, ["memory_id", "start_floor"], "tf", "length", [Best(k)], only, place)

    key = [*SCOPE, "_q"]
    best = staged(top_k(bounds, key, [F.desc("_bound"), F.asc("range")], first, "_place"), "first_ranges")
    # A query's threshold is the k-th score of its first ranges; without k of them all is read.
    found = top_k(scored(best), key, by_score(), k)
    threshold = found.filter(F.col("rank") == k).select("_q", F.col("score").alias("_threshold"))
    needed = bounds.join(threshold, "_q", "left").filter(
        F.col("_threshold").isNull() | (F.col("_bound") >= F.col("_threshold") * F.lit(1 - _SLACK) - F.lit(_TIE))
    )
    return staged(needed.select(*_ASKED, "_q"), "needed"), scored


def needed_blocks(
    postings: DataFrame, blocks: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, first: int = FIRST
) -> DataFrame:
    """The blocks of each query that may hold one of its k best documents."""
    stats = corpus_stats(lengths)
    needed = None
    for asked in ask(query_terms(queries)):
        some = _needed_ranges(postings, blocks, stats, asked, positive_or(k, DEFAULT_TOP_K), first)[0].select(*_ASKED)
        needed = some if needed is None else needed.unionByName(some)
    return _asked_blocks(blocks, stats, queries).join(needed, _ASKED, "left_semi")


def block_max_topk(
    postings: DataFrame, blocks: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, first: int = FIRST
) -> DataFrame:
    """The rows of ``search_index``, from the blocks that are needed only."""
    k = positive_or(k, DEFAULT_TOP_K)
    stats = corpus_stats(lengths)
    found = None
    for asked in ask(query_terms(queries)):
        needed, scored = _needed_ranges(postings, blocks, stats, asked, k, first)
        some = scored(needed).drop("_q")
        found = some if found is None else found.unionByName(some)
    return top_k(found, [*SCOPE, "query_id"], by_score(), k)


def blocks_read(
    postings: DataFrame, blocks: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, first: int = FIRST
) -> DataFrame:
    """Per query: blocks and postings of its terms, and how many of them are read."""
    keys = [*SCOPE, "query_id"]
    asked = _asked_blocks(blocks, corpus_stats(lengths), queries)
    everything = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.sum("postings").alias("postings"))
    needed = needed_blocks(postings, blocks, lengths, queries, k, first)
    read = needed.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks_read"), F.sum("postings").alias("postings_read"))
    return everything.join(read, keys)
