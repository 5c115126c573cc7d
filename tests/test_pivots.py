"""Pruned vector search against the search of all vectors."""

import random

from pyspark.sql import functions as F

from turnledger.operators import pivots as pv
from turnledger.operators.vectors import vector_topk

VECTORS = "chat_id string, branch_id string, memory_id string, start_floor long, vector array<double>"
QUERIES = "chat_id string, branch_id string, query_id string, vector array<double>"


def tables(spark, seed=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    near = lambda c: [x + rng.gauss(0, 0.05) for x in c]
    rows = [("c", "b", f"m{i}", i // 3, near(centres[i % 10])) for i in range(600)]
    rows += [("c", "b", f"same{i}", i % 4, rows[5][4]) for i in range(40)]  # ties
    rows += [("c", 'odd"branch', f"o{i}", i, [1.0, float(i)]) for i in range(30)]
    rows += [("c", "b", "zero", 1, [0.0] * 8), ("c", "b", "none", 1, None), ("c", "b", "nan", 1, [float("nan")] * 8), ("c", "b", "two", 1, [1.0, 2.0])]
    asked = [("c", "b", f"q{i}", near(centres[i])) for i in range(10)]
    asked += [("c", "b", f"away{i}", [-x for x in centres[i]]) for i in range(3)]
    asked += [("c", "b", "two", [1.0, 0.0]), ("c", "b", "empty", []), ("c", "b", "null", None), ("c", 'odd"branch', "q0", [1.0, 3.0]), ("x", "y", "q0", [1.0])]
    return spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asked, QUERIES)


def rows(df):
    return sorted(map(tuple, df.select("chat_id", "branch_id", "query_id", "rank", "memory_id", F.round("score", 9)).collect()))


def kept(spark, path, df):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_pruned_search_equals_all_pairs_and_skips(spark, tmp_path):
    vectors, queries = tables(spark)
    pivots = kept(spark, tmp_path / "pivots", pv.choose_pivots(vectors, 24))
    stored = kept(spark, tmp_path / "rows", pv.clustered(vectors, pivots))
    assert stored.count() == vectors.count()
    clusters = kept(spark, tmp_path / "clusters", pv.cluster_bounds(stored))
    assert rows(pv.pruned_topk(stored, clusters, pivots, queries, 5)) == rows(vector_topk(vectors, queries, 5))
    read = pv.needed_clusters(stored, clusters, pivots, queries, 5).filter("query_id like 'q%' and branch_id = 'b'")
    assert read.agg(F.sum("vectors")).first()[0] * 2 < vectors.filter("branch_id = 'b'").count() * 10


def test_pruned_search_of_nothing(spark):
    vectors, queries = tables(spark)
    empty = vectors.limit(0)
    pivots = pv.choose_pivots(empty)
    stored = pv.clustered(empty, pivots)
    assert pv.pruned_topk(stored, pv.cluster_bounds(stored), pivots, queries).count() == 0
