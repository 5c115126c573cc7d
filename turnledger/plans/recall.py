"""Hybrid recall: BM25 and vectors, fused, optionally reranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.operators import bm25, fusion, vectors
from turnledger.operators.bm25 import SCOPE

QUERY = [*SCOPE, "query_id"]


@dataclass(frozen=True)
class RecallOptions:
    """Defaults are fixed values of the recall pipeline."""

    bm25_top_k: int = 10
    embedding_top_k: int = 10
    rrf_k: float = 60
    rerank_enabled: bool = False
    rerank_candidate_limit: int = 20
    final_recall_count: int = 6


def recall(
    queries: DataFrame,
    memories: DataFrame | None = None,
    stored_vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    reranker: fusion.Reranker | None = None,
    options: RecallOptions = RecallOptions(),
) -> tuple[DataFrame, DataFrame]:
    """(final memories per query, error rows).

    A source that is not available is an error row and the other one decides alone; when
    neither is, the call fails. ``queries``: scope, query_id, text.
    """
    lists: dict[str, DataFrame] = {}
    missing: list[str] = []
    if memories is not None:
        lists["bm25"] = bm25.bm25_topk(memories, queries, options.bm25_top_k)
    else:
        missing.append("bm25")
    if stored_vectors is not None and query_vectors is not None:
        lists["embedding"] = vectors.vector_topk(
            stored_vectors, query_vectors, options.embedding_top_k
        )
    else:
        missing.append("embedding")
    if not lists:
        raise ValueError("long memory recall failed: both retrieval sources are missing")
    errors = queries.select(*QUERY, F.explode(F.array(*[F.lit(m) for m in missing]).cast("array<string>")).alias("source")).withColumn(
        "message", F.lit("retrieval source is not available")
    )
    fused = fusion.fuse(lists, options.rrf_k)
    scores = None
    if options.rerank_enabled and reranker is not None and memories is not None:
        scores = _rerank(fused, queries, memories, reranker, options)
    final = fusion.select_final(
        fused,
        scores,
        options.rerank_enabled,
        options.rerank_candidate_limit,
        options.final_recall_count,
    )
    if scores is not None:
        failed = final.filter("rerank_status = 'failed'").select(*QUERY).distinct()
        errors = errors.unionByName(
            failed.select(*QUERY, F.lit("rerank").alias("source"), F.lit("reranker failed").alias("message"))
        )
    return final, errors


def _rerank(
    fused: DataFrame,
    queries: DataFrame,
    memories: DataFrame,
    reranker: fusion.Reranker,
    options: RecallOptions,
) -> DataFrame:
    """Scores of the pools that are larger than the final count; other pools are never sent."""
    pool = fusion.rank_fused(fused, options.rerank_candidate_limit)
    sizes = pool.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("_n"))
    useful = sizes.filter(F.col("_n") > options.final_recall_count).select(*QUERY)
    text = memories.select(
        *SCOPE, "memory_id", vectors.embedding_text(set(memories.columns)).alias("document")
    )
    rows = (
        pool.join(useful, QUERY, "left_semi")
        .join(text, [*SCOPE, "memory_id"])
        .join(queries.select(*QUERY, F.col("text").alias("query_text")), QUERY)
    )
    return fusion.score_pool(rows, reranker)
