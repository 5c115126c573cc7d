"""Time the headline operators; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the input and the cores. Inputs that a deployment keeps
as tables (state nodes, the text index) are written once before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from turnledger.operators import bm25, chain, memory, pack, state_log, vectors
from turnledger.operators.floors import with_keys
from turnledger.plans import prepare, rebuild
from turnledger.session import build_session
from turnledger.sources import tables

_NODES = (
    "chat_id string, branch_id string, floor_id string, message_index bigint, state_node_id string, "
    "previous_state_fingerprint string, dependency_fingerprint string, state_fingerprint string, status string, created_at bigint"
)
_PATCHES = "chat_id string, branch_id string, state_node_id string, message_index bigint, path string, value string"


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus) if cpus.isdigit() else 8,
        {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    from registry import base, chats, retrieval

    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    times: dict[str, float] = {}
    rates: dict[str, float] = {}

    def timed(name: str, make, count: float | None = None) -> None:
        best = None
        for _ in range(2):
            start = time.time()
            make().write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        if count:
            rates[name] = round(count / best, 1)

    def kept(df, name: str):
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    docs = kept(base.memories(spark, sf).repartition(16), "memories")
    asked = base.searches(spark, sf)
    n_queries, n_docs = asked.count(), docs.count()
    start = time.time()
    tables.publish_index(*bm25.build_index(docs), f"{root}/index", buckets=16)
    times["bm25_build_index"] = round(time.time() - start, 3)
    rates["bm25_build_index"] = round(n_docs / times["bm25_build_index"], 1)
    postings = tables.read_current(spark, f"{root}/index/postings").drop("bucket")
    lengths = tables.read_current(spark, f"{root}/index/lengths")
    timed("bm25_search_batch", lambda: bm25.search_index(postings, lengths, asked), n_queries)
    timed("bm25_search_without_index", lambda: bm25.bm25_topk(docs, asked), n_queries)

    # The published figure is for two-term queries over all documents in one scope.
    one_scope = docs.withColumn("branch_id", F.lit("all"))
    tables.publish_index(*bm25.build_index(one_scope), f"{root}/one", buckets=16)
    words = F.slice(F.split("summary", r"\W+"), 2, 2)
    pairs = kept(
        one_scope.filter("start_floor % 4 = 0").select(
            "chat_id", "branch_id", F.col("memory_id").alias("query_id"), F.array_join(words, " ").alias("text")
        ),
        "pairs",
    )
    one_postings = tables.read_current(spark, f"{root}/one/postings").drop("bucket")
    one_lengths = tables.read_current(spark, f"{root}/one/lengths")
    timed("bm25_two_term_queries", lambda: bm25.search_index(one_postings, one_lengths, pairs), pairs.count())

    probes = retrieval._vector_queries(spark, sf)
    timed("vector_topk", lambda: vectors.vector_topk(base.vectors(spark, sf), probes), probes.count())

    nodes = kept(base.nodes(spark, sf), "nodes")
    positions = kept(base.event_floors(spark, sf).drop("user_id", "event_id", "content"), "positions")
    n_floors = positions.count()
    timed("trusted_prefix", lambda: chain.trusted_prefix(positions, nodes, F.lit("p1")), n_floors)
    timed("batch_ranges", lambda: memory.expected_ranges(nodes, 10), n_floors)

    # The published figure is for building one chain of 1000 floors from nothing.
    chain_floors = kept(
        with_keys(
            spark.range(1000).select(
                F.lit("chat").alias("chat_id"), F.lit("main").alias("branch_id"), F.col("id").alias("message_index"),
                F.lit(None).cast("int").alias("swipe_id"),
                F.concat(F.lit("Day "), F.col("id").cast("string"), F.lit(" mood "), (F.col("id") % 5).cast("string")).alias("content"),
            )
        ).withColumn("status", F.lit("pending")),
        "chain_floors",
    )
    rules = {"/story/now/time": r"Day (\d+)", "/profiles/npc/situation/mood": r"mood (\d)"}
    start = time.time()
    done = rebuild.rebuild_until_valid(
        chain_floors,
        spark.createDataFrame([], _NODES),
        spark.createDataFrame([], _PATCHES),
        rebuild.regex_extractor(rules),
        "p1",
        f"{root}/chain",
        first_block=64,
        growth=16,
    )
    assert done.nodes.count() == 1000 and done.left.isEmpty()
    times["chain_build_1000"] = round(time.time() - start, 3)
    rates["chain_build_1000"] = round(1000 / times["chain_build_1000"], 1)

    log = kept(base.log(spark, sf), "log")
    timed("state_fold_latest", lambda: state_log.latest_state(log), n_floors)
    timed(
        "state_node_fingerprints",
        lambda: state_log.node_fingerprints(
            state_log.state_versions(log), log.select("chat_id", "branch_id", "seq").distinct()
        ),
        n_floors,
    )
    timed("chat_reconcile", lambda: chats._reconciled(spark, sf))
    recalled = kept(bm25.search_index(postings, lengths, asked, 6), "recalled")
    requests = asked.withColumn("context_size", F.lit(100000))
    timed(
        "greedy_pack",
        lambda: prepare.pack_for_requests(requests, recalled, docs, pack.PackOptions()),
        n_queries,
    )

    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "per_second": rates,
                "sf": sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
