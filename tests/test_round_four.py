"""What grows with the tables stays off the driver; sparse chats take one block."""

from pyspark.sql import functions as F

from turnledger.operators import chain, quality, skew, vectors
from turnledger.operators import context as cx


def executed(df):
    df._jdf.queryExecution().toRdd().count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_locks_are_not_broadcast(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("k")).write.parquet(f"{tmp_path}/k")
    rows = spark.read.parquet(f"{tmp_path}/k")
    path = F.concat(F.lit("/profiles/c"), F.col("k").cast("string"), F.lit("/basic/age"))
    writes = rows.select("k", F.explode(F.array(path, F.lit("/story/now"))).alias("path"))
    dotted = F.concat(F.lit("profiles.c"), F.col("k").cast("string"))
    locks = rows.filter("k % 3 = 0").select("k", F.explode(F.array(dotted, F.concat(dotted, F.lit(".basic.age.x")))).alias("locked_path"))
    hits = quality.locked_writes(writes, locks, ["k"])
    assert "Broadcast" not in executed(hits)
    assert {r.k for r in hits.collect()} == set(range(0, 300, 3))


def test_documents_of_mappings_are_not_broadcast(spark, tmp_path):
    spark.range(40).select(F.col("id").cast("string").alias("query_id")).write.parquet(f"{tmp_path}/q")
    base = spark.read.parquet(f"{tmp_path}/q").select(
        F.lit("x").alias("chat_id"), F.lit("main").alias("branch_id"), "query_id", F.lit('{"p":{"k":1}}').alias("document")
    )
    row = {"mapping_id": "m", "external_path": "p.k", "domain": "profile", "path": "basic.age", "field": None,
           "character_id": "c1", "item_id": None, "semantic_key": None, "mode": "equivalent"}
    mappings = base.select(*cx.QUERY, *[F.lit(v).cast("string").alias(n) for n, v in row.items()], F.lit(True).alias("enabled"))
    found = cx.resolve_mappings(mappings, base)
    assert "Broadcast" not in executed(found)
    assert [r.outcome for r in found.collect()] == ["equivalent"] * 40


def test_short_chains_are_shuffled_once(spark, tmp_path):
    """Sparse indexes: 40 chats of 30 floors over 300 000 places. Floors and nodes go by floor, then by chat."""
    ids = spark.range(1200).select(
        (F.col("id") % 40).cast("string").alias("chat_id"), F.lit("b").alias("branch_id"), (F.col("id") * 250).alias("message_index"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("floor_id"), F.col("id").cast("string").alias("body_fingerprint"),
    )
    ids.withColumn("status", F.lit("synced")).write.parquet(f"{tmp_path}/p")
    ids.select(
        "chat_id", "branch_id", "floor_id", "message_index", F.concat(F.lit("n"), "floor_id").alias("state_node_id"),
        F.lit(None).cast("string").alias("previous_state_fingerprint"), F.lit("d").alias("dependency_fingerprint"),
        F.lit("s").alias("state_fingerprint"), F.lit(1).alias("created_at"),
    ).write.parquet(f"{tmp_path}/n")
    prefix = chain.trusted_prefix(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/n"), F.lit("p1"))
    tracker, before = spark.sparkContext._jsc.sc().statusStore(), set()
    stages = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    )
    before = {s.stageId() for s in stages()}
    rows = prefix.collect()
    written = sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)
    assert len(rows) == 1200 and sum(r.lineage_valid for r in rows) == 40
    # Floors, nodes, floors with their nodes, and one count a chat and task.
    assert written <= 3 * 1200 + 40 * 8 + 10


def test_a_sparse_key_is_one_block(spark):
    rows = [("long", i) for i in range(40)] + [("sparse", i * 1000) for i in range(7)] + [(None, 5)]
    df = spark.createDataFrame(rows, "k string, o bigint")
    blocks = {r.k: r.n for r in skew._blocks(df, ["k"], "o", 7).groupBy("k").agg(F.count_distinct("_block").alias("n")).collect()}
    assert blocks == {"long": 6, "sparse": 1, None: 1}
    got = {(r.k, r.o): r.ordinal for r in skew.ordinal(df.filter("k is not null"), ["k"], "o", size=7).collect()}
    assert got == {("long", i): i + 1 for i in range(40)} | {("sparse", i * 1000): i + 1 for i in range(7)}


def test_cosines_count_to_their_twelfth_decimal(spark):
    """Two cosines a few 1e-10 apart are no tie, whichever floor is earlier and wherever their blocks are."""
    near = [1.0, 1e-6]
    stored = [("c", "b", "early", 1, [1.0, 3e-5]), ("c", "b", "late", 2, near)]
    df = spark.createDataFrame(stored, "chat_id string, branch_id string, memory_id string, start_floor int, vector array<double>").repartition(2, "start_floor")
    asked = spark.createDataFrame([("c", "b", "q", [1.0, 0.0])], "chat_id string, branch_id string, query_id string, vector array<double>")
    found = {r["rank"]: (r.memory_id, r.score) for r in vectors.vector_topk(df, asked).collect()}
    assert 0 < found[1][1] - found[2][1] < 1e-9
    assert [found[1][0], found[2][0]] == ["late", "early"]
