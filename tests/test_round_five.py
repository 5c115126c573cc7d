"""Stored segments, documents opened in one pass, and checks without joins of their rows."""

import json
import os

from pyspark.sql import functions as F

from turnledger.operators import checkpoints as cp
from turnledger.operators import quality, state_log


def parts_of(folder, name):
    return sum(f.endswith(".parquet") for _, _, files in os.walk(f"{folder}/{name}") for f in files)


def test_a_segment_is_not_dealt_to_every_task(spark, folder):
    """Was: one file for each pair of a segment and a task."""
    events = spark.range(4000).select(
        (F.col("id") % 50).cast("string").alias("chat_id"), F.lit("m").alias("branch_id"), F.col("id").alias("seq"),
        F.lit("replace").alias("op"), F.lit("/p").alias("path"), F.lit("value").alias("kind"), F.lit("1").alias("value"),
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cp.append_log(events, folder, 100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len([d for d in os.listdir(f"{folder}/log") if d.startswith("segment=")]) == 40
    assert parts_of(folder, "log") <= 40 + 4
    assert spark.read.parquet(f"{folder}/log").count() == 4000


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_opened_once_for_all_checks(spark):
    """Was: opened for every reading of their rows, which were shuffled to meet each other."""
    text = json.dumps({"schemaVersion": 2, "zz": {"y": [1, {"x": 2}]}, "branchId": "B", "profiles": {"k": {"characterId": "i"}}})
    docs = spark.createDataFrame([(1, "B", text), (2, "B", "no json")], "id int, branch_id string, doc string")
    found = quality.snapshot_violations(docs, ["id"], "doc", "branch_id")
    rows = {(r.id, r.path, r.reason) for r in found.collect()}
    assert {(1, "/zz", "is an unknown field"), (1, "/schemaVersion", "is invalid"), (2, "", "is not JSON"),
            (1, "/traces", "is required"), (1, "/profiles/k/characterId", "must match the map key")} <= rows
    assert not [r for r in rows if r[1].startswith("/zz/")]  # only the topmost
    plan = plan_of(found)
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1 and "Generate" in plan


def test_opened_rows_name_members(spark):
    docs = spark.createDataFrame([(1, '{"b":[{"a/c":1,"~":{}}],"a":null}')], "id int, doc string")
    rows = {(r.path, r.kind, r.value, r.members) for r in state_log.open_documents(docs, ["id"], "doc").collect()}
    assert rows == {("", "object", None, "a/b"), ("/a", "value", "null", None), ("/b", "array", None, None),
                    ("/b/0", "object", None, "a~1c/~0"), ("/b/0/a~1c", "value", "1", None), ("/b/0/~0", "object", None, "")}
    closed = {(r.path, r.kind, r.value) for r in state_log.flatten_documents(docs, ["id"], "doc").collect()}
    assert closed == {("", "object", None), ("/a", "value", "null"), ("/b", "value", '[{"a/c":1,"~":{}}]')}


def test_pairs_of_several_bands_are_met_once(spark):
    """Was: a row for every band that a pair shares."""
    from turnledger.llm.bagminhash import SKETCH, crossed_pairs

    rows = [(band, key, 100, 5, key, [0] * (SKETCH // 64)) for key, bands in (("a", (1, 2, 3, 4)), ("b", (2, 3, 4)), ("c", (4, 9))) for band in bands]
    apart = spark.createDataFrame(rows, "band long, key string, n long, own long, class string, sketch array<long>")
    assert sorted(map(tuple, crossed_pairs(apart, 0.8).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
