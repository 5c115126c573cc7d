from pyspark.sql import functions as F

from turnledger.operators import branches as br
from turnledger.operators import floors as fl

IN = "chat_id string, branch_id string, message_index int, swipe_id int, content string"
STORED = (
    "floor_id string, chat_id string, branch_id string, message_index int, swipe_id int, body_fingerprint string, "
    "content string, active boolean, status string, created_at timestamp, updated_at timestamp"
)
NOW = "2026-01-01"


def snapshot(spark, *floors, chat="c", branch="main:c"):
    return spark.createDataFrame([(chat, branch, *f) for f in floors], IN)


def step(stored, incoming):
    out = fl.reconcile(stored, incoming, F.lit(NOW).cast("timestamp"))
    counts = {r.content: r.outcome for r in out.collect()}
    return out.drop("outcome"), counts


def fixed(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_reconcile_life_of_a_chat(spark):
    empty = spark.createDataFrame([], STORED)
    first, seen = step(empty, snapshot(spark, (2, 0, "two"), (4, 0, "four")))
    assert seen == {"two": "created", "four": "created"}
    stored = fixed(spark, first).withColumn("status", F.lit("synced"))

    same, seen = step(stored, snapshot(spark, (2, 0, "two"), (4, 0, "four")))
    assert seen == {"two": "reused", "four": "reused"}
    assert {r.status for r in same.collect()} == {"synced"}

    edited, seen = step(stored, snapshot(spark, (2, 0, "two"), (4, 0, "four v2")))
    assert seen == {"two": "reused", "four": "replaced", "four v2": "created"}
    state = {r.content: (r.active, r.status) for r in edited.collect()}
    assert state == {"two": (True, "synced"), "four": (False, "stale"), "four v2": (True, "pending")}

    swiped, seen = step(fixed(spark, edited), snapshot(spark, (2, 0, "two"), (4, 1, "four alt")))
    assert seen["four v2"] == "inactive" and seen["four alt"] == "created"
    assert {r.content: r.status for r in swiped.collect()}["four v2"] == "pending"

    cut, seen = step(fixed(spark, swiped), snapshot(spark, (2, 0, "two")))
    assert {k for k, v in seen.items() if v == "removed"} == {"four", "four v2", "four alt"}

    back, seen = step(fixed(spark, cut), snapshot(spark, (2, 0, "two"), (4, 0, "four")))
    assert seen["four"] == "reused"
    assert {r.content: r.status for r in back.collect()}["four"] == "pending"


def test_scopes_without_a_snapshot_are_untouched(spark):
    empty = spark.createDataFrame([], STORED)
    both = snapshot(spark, (1, None, "a")).unionByName(snapshot(spark, (1, None, "b"), chat="d", branch="main:d"))
    stored = fixed(spark, step(empty, both)[0])
    _, seen = step(stored, snapshot(spark, (1, None, "a2")))
    assert seen == {"a": "replaced", "a2": "created", "b": "untouched"}


def test_duplicate_locator_rejects_the_request(spark):
    incoming = snapshot(spark, (1, None, "a"), (1, 0, "b"), (2, 0, "c")).unionByName(
        snapshot(spark, (1, 0, "x"), chat="d", branch="main:d")
    )
    clean, duplicates = fl.reject_duplicate_requests(incoming)
    assert [r.content for r in clean.collect()] == ["x"]
    assert [(r.message_index, r.copies) for r in duplicates.collect()] == [(1, 2)]


def test_upsert_keeps_flag_and_creation(spark):
    stored = fixed(spark, step(spark.createDataFrame([], STORED), snapshot(spark, (1, 0, "a")))[0]).withColumn("active", F.lit(False))
    again = stored.withColumn("status", F.lit("failed")).withColumn("updated_at", F.lit("2026-03-01").cast("timestamp")).withColumn("active", F.lit(True))
    row = fl.upsert_floors(stored, again).first()
    assert (row.active, row.status, str(row.created_at)[:10], str(row.updated_at)[:10]) == (False, "failed", "2026-01-01", "2026-03-01")


def test_fork_copies_up_to_the_floor_and_leaves_the_source(spark):
    incoming = snapshot(spark, *[(i, None, f"{i}A") for i in range(10, 15)])
    stored = fixed(spark, step(spark.createDataFrame([], STORED), incoming)[0])
    at = stored.filter("message_index = 12").select(
        "chat_id", F.col("branch_id").alias("source_branch_id"), F.col("floor_id").alias("fork_floor_id"), F.lit("fork").alias("branch_id")
    )
    foreign = at.withColumn("source_branch_id", F.lit("elsewhere"))
    valid, rejects = br.check_forks(at.unionByName(foreign), stored)
    assert rejects.count() == 1
    every = br.add_forked(stored, br.fork_variants(valid, stored))
    assert every.filter("branch_id = 'fork'").count() == 3
    assert br.add_forked(every, br.fork_variants(valid, stored)).count() == every.count()
    edited, _ = step(fixed(spark, every), snapshot(spark, (10, None, "10A"), (11, None, "11B"), branch="fork"))
    main = edited.filter("branch_id = 'main:c'")
    assert {(r.content, r.active, r.status) for r in main.collect()} == {(f"{i}A", True, "pending") for i in range(10, 15)}


def test_activation_leaves_one_active_branch(spark):
    rows = [("c", "main", True), ("c", "fork", False), ("d", "main:d", True)]
    branches = spark.createDataFrame(rows, "chat_id string, branch_id string, active boolean")
    asked = spark.createDataFrame([("c", "fork"), ("d", "lost")], "chat_id string, branch_id string")
    updated, rejects = br.activate_branches(branches, asked)
    assert {(r.branch_id, r.active) for r in updated.collect()} == {("main", False), ("fork", True), ("main:d", True)}
    assert [r.branch_id for r in rejects.collect()] == ["lost"]
