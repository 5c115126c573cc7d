"""Exact vector search that skips clusters of vectors by the triangle inequality of angles.

Every vector of a scope belongs to the pivot (one of ``PIVOTS`` stored vectors) with the
largest cosine, and a cluster keeps the smallest and the largest angle to its pivot. A query
at angle a to the pivot is at least ``a - largest`` and ``smallest - a`` away from every
vector of the cluster, which bounds their cosine:

1. The clusters with the best bounds of a query are searched; its k-th score there is the
   threshold.
2. Clusters whose bound is below it are skipped; all others are searched in full.

Vectors without a positive cosine to any pivot are a cluster of their own that is always
searched. Cosines come from ``vector_topk``, so scores and ties are the same.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.operators.bm25 import SCOPE, by_score
from turnledger.operators.ranking import positive_or, top_k
from turnledger.operators.vectors import DEFAULT_TOP_K, vector_topk

PIVOTS = 16
#: Clusters of a query that are searched for its threshold.
FIRST = 2
#: Tasks of one cluster. A query is repeated for each of its clusters, and each of these.
SALTS = 4
# Cosines have 12 decimals; an angle near 0 then has about 6.
_ANGLE_SLACK, _SCORE_SLACK = 1e-5, 1e-9
_KEY = [*SCOPE, "query_id"]


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> DataFrame:
    """``count`` vectors of each scope, by the hash of their ids."""
    order = [F.asc(F.xxhash64("memory_id")), F.asc("memory_id")]
    return top_k(vectors, SCOPE, order, count, "_place").drop("_place")


def clustered(vectors: DataFrame, pivots: DataFrame) -> DataFrame:
    """``vectors`` with ``cluster`` (the pivot's id, null: none) and ``angle`` to it, ready to be written."""
    asked = vectors.select(*SCOPE, F.col("memory_id").alias("query_id"), "vector")
    nearest = vector_topk(pivots, asked, 1).select(
        *SCOPE,
        F.col("query_id").alias("_id"),
        F.col("memory_id").alias("cluster"),
        F.acos(F.least(F.col("score"), F.lit(1.0))).alias("angle"),
    )
    rows = vectors.select(*SCOPE, "memory_id", "start_floor", "vector").withColumn("_id", F.col("memory_id"))
    return rows.join(nearest, [*SCOPE, "_id"], "left").drop("_id")


def cluster_bounds(rows: DataFrame) -> DataFrame:
    """Vectors and smallest and largest angle of each cluster."""
    return rows.groupBy(*SCOPE, "cluster").agg(
        F.count(F.lit(1)).alias("vectors"), F.min("angle").alias("near"), F.max("angle").alias("far")
    )


def _bounds(clusters: DataFrame, pivots: DataFrame, queries: DataFrame) -> DataFrame:
    """Clusters of a query's scope with the largest cosine that a vector of theirs can have."""
    seen = vector_topk(pivots, queries, 1 << 30).select(
        *_KEY, F.col("memory_id").alias("cluster"), F.acos(F.least(F.col("score"), F.lit(1.0))).alias("_to")
    )
    pairs = queries.select(*_KEY).join(clusters, SCOPE).join(seen, [*_KEY, "cluster"], "left")
    # A pivot that was not seen is a right angle or more away, so only its outer bound holds.
    outer = F.coalesce("_to", F.lit(pi / 2)) - F.col("far")
    away = F.greatest(F.lit(0.0), outer, F.coalesce(F.col("near") - F.col("_to"), F.lit(0.0))) - F.lit(_ANGLE_SLACK)
    bound = F.when(F.col("cluster").isNull(), F.lit(1.0)).otherwise(F.cos(F.greatest(F.lit(0.0), away)))
    return pairs.select(*_KEY, "cluster", "vectors", bound.alias("bound")).filter("bound > 0")


def _in_clusters(rows: DataFrame) -> DataFrame:
    """``branch_id`` made to name the cluster too, so that a search stays inside of it."""
    return rows.withColumn("branch_id", F.to_json(F.struct("branch_id", "cluster")))


def _searched(rows: DataFrame, queries: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    asked = queries.join(chosen.select(*_KEY, "cluster"), _KEY).select(*_KEY, "cluster", "vector")
    best = vector_topk(_in_clusters(rows), _in_clusters(asked), k, SALTS).drop("rank")
    best = best.withColumn("branch_id", F.get_json_object("branch_id", "$.branch_id"))
    return top_k(best, _KEY, by_score(digits=None), k)


def needed_clusters(
    rows: DataFrame, clusters: DataFrame, pivots: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, first: int = FIRST
) -> DataFrame:
    """Clusters that may hold one of a query's k best vectors, with their numbers of vectors."""
    k = positive_or(k, DEFAULT_TOP_K)
    bounds = _bounds(clusters, pivots, queries)
    best = top_k(bounds, _KEY, [F.desc("bound"), F.asc("cluster")], first, "_place")
    threshold = (
        _searched(rows, queries, best, k).filter(F.col("rank") == k).select(*_KEY, F.col("score").alias("_threshold"))
    )
    enough = F.col("_threshold").isNull() | (F.col("bound") >= F.col("_threshold") - F.lit(_SCORE_SLACK))
    return bounds.join(threshold, _KEY, "left").filter(enough).drop("_threshold")


def pruned_topk(
    rows: DataFrame, clusters: DataFrame, pivots: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, first: int = FIRST
) -> DataFrame:
    """The rows of ``vector_topk``, from the clusters that are needed only.

    ``rows``: of ``clustered``; ``clusters``: of ``cluster_bounds``; queries are unique by scope and id.
    """
    needed = needed_clusters(rows, clusters, pivots, queries, k, first)
    return _searched(rows, queries, needed, positive_or(k, DEFAULT_TOP_K))
