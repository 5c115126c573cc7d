"""Reciprocal rank fusion and the optional rerank stage."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.operators.bm25 import SCOPE
from turnledger.operators.ranking import top_k

DEFAULT_RRF_K = 60
DEFAULT_CANDIDATES = 20
DEFAULT_FINAL = 6
# Decimals of a fused score that count for its rank.
RRF_DIGITS = 12


def fuse(lists: dict[str, DataFrame], k: float = DEFAULT_RRF_K) -> DataFrame:
    """Sum of 1/(k + rank) over the sources that returned a memory.

    Each list has scope, query_id, memory_id, start_floor, rank, score. A memory listed
    twice by one source counts once, at its best rank.
    """
    constant = float(k) if isinstance(k, (int, float)) and math.isfinite(k) and k >= 1 else 60.0
    keys = [*SCOPE, "query_id", "memory_id", "start_floor"]
    merged = None
    for source, ranked in lists.items():
        rows = ranked.select(*keys, F.lit(source).alias("source"), "rank", "score")
        merged = rows if merged is None else merged.unionByName(rows)
    best = merged.groupBy(*keys, "source").agg(
        F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score")
    )
    entry = F.struct("source", "rank")
    scored = F.struct("source", "score")
    fused = best.groupBy(*keys).agg(
        F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("rrf_score"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("ranks"),
        F.map_from_entries(F.array_sort(F.collect_list(scored))).alias("scores"),
    )
    return fused


def fused_order() -> list[Column]:
    """Best first; sums of the same parts in another order are a tie."""
    return [F.desc(F.round("rrf_score", RRF_DIGITS)), F.asc("start_floor"), F.asc("memory_id")]


def rank_fused(fused: DataFrame, limit: int) -> DataFrame:
    return top_k(fused, [*SCOPE, "query_id"], fused_order(), limit, "rrf_rank")


Reranker = Callable[[pd.Series, pd.Series], pd.Series]


def score_pool(pool: DataFrame, scorer: Reranker, max_chars: int | None = None) -> DataFrame:
    """Relevance per pool row from a user scorer ``(query_text, document) -> score``.

    ``pool`` carries query_text and document. Documents are given whole unless the caller
    names the ``max_chars`` its model reads. Each query is scored by itself, so one that fails
    is left unscored with the error kept and does not touch others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby([*SCOPE, "query_id"], sort=False, dropna=False):
                error = None
                try:
                    scores = scorer(part["query_text"], part["document"].str.slice(0, max_chars))
                    scores = pd.Series(scores, dtype="float64").to_numpy()
                except Exception as exc:  # the scorer is user code
                    scores, error = [None] * len(part), str(exc)
                yield part.drop(columns=["query_text", "document"]).assign(
                    rerank_score=scores, error=error
                )

    types = dict(pool.dtypes)
    return pool.select(*SCOPE, "query_id", "memory_id", "query_text", "document").mapInPandas(
        run,
        f"chat_id string, branch_id string, query_id {types['query_id']}, "
        f"memory_id {types['memory_id']}, rerank_score double, error string",
    )


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf"))


def select_final(
    fused: DataFrame,
    scores: DataFrame | None = None,
    enabled: bool = False,
    candidates: int = DEFAULT_CANDIDATES,
    final: int = DEFAULT_FINAL,
) -> DataFrame:
    """Final memories per query with their rank and the rerank status.

    Reranking is skipped when the pool is no larger than the final count, since it could
    not change the selection. Once it is applied the final rows come from the pool alone,
    best score first; rows without a score go last. A query whose scoring failed keeps
    the fused order.
    """
    query = [*SCOPE, "query_id"]
    depth = max(candidates, final)
    ranked = rank_fused(fused, depth)
    whole = Window.partitionBy(*query)
    if not enabled:
        status = F.lit("disabled")
        joined = ranked.withColumn("rerank_score", F.lit(None).cast("double"))
        joined = joined.withColumn("rerank_status", status)
    elif scores is None:
        joined = ranked.withColumn("rerank_score", F.lit(None).cast("double")).withColumn(
            "rerank_status", F.lit("not_configured")
        )
    else:
        given = scores.select(
            *query,
            "memory_id",
            F.when(finite(F.col("rerank_score")), F.col("rerank_score")).alias("rerank_score"),
            (F.col("error") if "error" in scores.columns else F.lit(None)).alias("_error"),
        )
        joined = ranked.join(given, [*query, "memory_id"], "left")
        pool_size = F.least(F.count(F.lit(1)).over(whole), F.lit(candidates))
        failed = F.count("_error").over(whole) > 0
        joined = joined.withColumn(
            "rerank_status",
            F.when(pool_size <= final, "skipped_within_final")
            .when(failed, "failed")
            .otherwise("applied"),
        )
    applied = F.col("rerank_status") == "applied"
    in_pool = F.col("rrf_rank") <= candidates
    order = [
        F.desc(
            F.when(applied, F.coalesce("rerank_score", F.lit(float("-inf")))).otherwise(F.lit(0.0))
        ),
        *fused_order(),
    ]
    kept = joined.filter(~applied | in_pool)
    out = top_k(kept, query, order, final, "rank")
    return out.select(
        *query,
        "rank",
        "memory_id",
        "start_floor",
        "rrf_score",
        "ranks",
        "scores",
        F.when(applied, F.col("rerank_score")).alias("rerank_score"),
        "rerank_status",
    )


def rerank_scores(responses: DataFrame) -> DataFrame:
    """Rows ``(query_id, index, relevance_score)`` out of rerank response texts.

    ``responses``: query_id, response (JSON), document_count. Several field names are
    accepted for the list, the index and the score; rows out of range are dropped.
    """
    item = (
        "index string, document_index string, documentIndex string, relevance_score string, "
        "relevanceScore string, score string, rerank_score string"
    )
    flat = F.from_json("response", f"struct<results:array<struct<{_typed(item)}>>>")["results"]
    nested = F.from_json(
        "response", f"struct<data:struct<results:array<struct<{_typed(item)}>>>>"
    )["data"]["results"]
    listed = F.from_json("response", f"struct<data:array<struct<{_typed(item)}>>>")["data"]
    exploded = responses.select(
        "query_id", "document_count", F.explode(F.coalesce(flat, nested, listed)).alias("r")
    )
    index = F.coalesce("r.index", "r.document_index", "r.documentIndex")
    value = F.coalesce("r.relevance_score", "r.relevanceScore", "r.score", "r.rerank_score")
    position = index.try_cast("double")
    score = value.try_cast("double")
    rows = exploded.select(
        "query_id", "document_count", position.alias("_p"), score.alias("relevance_score")
    )
    return rows.filter(
        (F.col("_p") == F.floor("_p"))
        & (F.col("_p") >= 0)
        & (F.col("_p") < F.col("document_count"))
        & finite(F.col("relevance_score"))
    ).select("query_id", F.col("_p").cast("int").alias("index"), "relevance_score")


def _typed(fields: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (f.split() for f in fields.split(", ")))
