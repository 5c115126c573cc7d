import re

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from turnledger.functions.keys import fingerprint
from turnledger.operators import bm25, chain
from turnledger.operators.vectors import hashing_encoder
from turnledger.plans.rebuild import StateExtractor, rebuild_until_valid
from turnledger.sources import tables
from turnledger.streaming import fold, ingest, maintain

POSITIONS = "chat_id string, branch_id string, message_index bigint, floor_id string, content string"
NODES = (
    "chat_id string, branch_id string, floor_id string, message_index bigint, state_node_id string, "
    "previous_state_fingerprint string, dependency_fingerprint string, state_fingerprint string, status string, created_at bigint"
)
PATCHES = "chat_id string, branch_id string, state_node_id string, message_index bigint, path string, value string"


def age_reader():
    """A nested function travels to the workers by value, as a user's own extractor would."""

    def extract(text):
        found = re.search(r"age=(\d+)", text)
        return [("/profiles/a/basic/age", f'"{found.group(1)}"')] if found else []

    return extract


def floors(spark, contents):
    rows = [("c", "b", i, f"f{i}:{text}", text) for i, text in enumerate(contents, 1)]
    return spark.createDataFrame(rows, POSITIONS).withColumn("body_fingerprint", fingerprint(F.col("content"))).withColumn("status", F.lit("pending"))


def test_eight_floors_converge_after_an_edit(spark, folder):
    texts = ["one age=20", "two", "three", "four", "five age=30", "six", "seven", "eight"]
    none = spark.createDataFrame([], NODES), spark.createDataFrame([], PATCHES)
    done = rebuild_until_valid(floors(spark, texts), *none, age_reader(), "p1", f"{folder}/a", first_block=3, fold_size=3)
    assert done.rounds == 2 and done.left.isEmpty()
    assert {(r.message_index, r.op, r.old_value, r.new_value) for r in done.deltas.filter("path like '%age'").collect()} == {(1, "add", None, '"20"'), (5, "replace", '"20"', '"30"')}

    # Same meaning, other words: only the edited floor is analysed again.
    texts[2] = "three again"
    done = rebuild_until_valid(floors(spark, texts), done.nodes, done.patches, age_reader(), "p1", f"{folder}/b", first_round=20, fold_size=3)
    assert done.rounds == 1 and done.nodes.filter("created_at >= 20").count() == 1

    # Another meaning: floors 3 and 4 change, floor 5 sets the age again and the rest holds.
    texts[2] = "three age=21"
    done = rebuild_until_valid(floors(spark, texts), done.nodes, done.patches, age_reader(), "p1", f"{folder}/c", first_round=30, fold_size=3)
    nodes = done.nodes
    redone = nodes.filter("created_at >= 30").select("message_index").orderBy("message_index").collect()
    assert [r.message_index for r in redone] == [3, 4, 5]
    prefix = chain.trusted_prefix(floors(spark, texts), nodes, F.lit("p1"))
    assert prefix.filter("not valid").count() == 0

    # A new prompt breaks the strict chain only.
    drift = chain.chain_heads(chain.trusted_prefix(floors(spark, texts), nodes, F.lit("p2"))).first()
    assert (drift.first_invalid_index, drift.first_lineage_break_index) == (1, None)


def test_failing_floors_are_asked_once_and_left(spark, folder):
    texts = [f"n{i} age={i}" for i in range(12)]
    texts[7] = "bad"
    log = f"{folder}-calls"

    def extract(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        if text == "bad":
            raise ValueError("no")
        return [("/profiles/a/basic/age", text.split("=")[1])]

    none = spark.createDataFrame([], NODES), spark.createDataFrame([], PATCHES)
    done = rebuild_until_valid(floors(spark, texts), *none, extract, "p1", folder, first_block=2, growth=2, attempts=3)
    calls = open(log).read().split("\n")
    assert calls.count("bad") == 3 and all(calls.count(t) <= 1 for t in texts if t != "bad")
    left = {r.message_index: (r.attempts, r.reason) for r in done.left.collect()}
    assert set(left) == set(range(8, 13)) and left[8] == (3, "no") and left[9][1] == "the chain before it does not hold"
    assert {r.message_index for r in done.nodes.collect()} == set(range(1, 8))

    # Mended, the chain goes on where it stopped.
    texts[7] = "good age=7"
    done = rebuild_until_valid(floors(spark, texts), done.nodes, done.patches, extract, "p1", f"{folder}/next", first_round=50)
    assert done.left.isEmpty() and done.nodes.count() == 12


def counter(log):
    """Reads the state: every "+" adds one to what the floors before came to."""

    def ask(text, state):
        with open(log, "a") as f:
            f.write(text + "\n")
        if "bad" in text:
            raise ValueError("no")
        if "=" in text:
            return [("/story/count", f'"{text.split("=")[1]}"')]
        before = int(state.get("/story/count", '"0"').strip('"'))
        return [("/story/count", f'"{before + 1}"')] if "+" in text else []

    return StateExtractor(ask)


def counted(nodes, prefix, patches):
    """Count after each floor, from the patches of the valid chain."""
    chain_nodes = prefix.filter("valid").select("state_node_id")
    said = {r.message_index: int(r.value.strip('"')) for r in patches.join(chain_nodes, "state_node_id", "left_semi").filter("path = '/story/count'").collect()}
    return said


def test_an_extractor_that_reads_the_state_converges(spark, folder):
    log = f"{folder}-calls"
    texts = ["one +", "two", "three +", "four +", "five =10", "six +", "seven", "eight +"]
    none = spark.createDataFrame([], NODES), spark.createDataFrame([], PATCHES)
    done = rebuild_until_valid(floors(spark, texts), *none, counter(log), "p1", f"{folder}/a", first_block=8, fold_size=3)
    prefix = chain.trusted_prefix(floors(spark, texts), done.nodes, F.lit("p1"))
    assert prefix.filter("not valid").count() == 0 and done.left.isEmpty()
    assert counted(done.nodes, prefix, done.patches) == {1: 1, 3: 2, 4: 3, 5: 10, 6: 11, 8: 12}
    assert sorted(open(log).read().split("\n")[:-1]) == sorted(texts)  # each once

    # The edit changes what floors 3 and 4 come to; from floor 5 on the states are the same again.
    texts[1] = "two edited +"
    open(log, "w").close()
    done = rebuild_until_valid(floors(spark, texts), done.nodes, done.patches, counter(log), "p1", f"{folder}/b", first_round=20, first_block=8, fold_size=3)
    prefix = chain.trusted_prefix(floors(spark, texts), done.nodes, F.lit("p1"))
    assert prefix.filter("not valid").count() == 0
    assert counted(done.nodes, prefix, done.patches) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 10, 6: 11, 8: 12}
    assert open(log).read().split("\n")[:-1] == ["two edited +", "three +", "four +", "five =10"]


def test_floors_are_walked_in_order_up_to_a_failure(spark, folder):
    from turnledger.operators.state_log import leaf_changes, leaf_fingerprints
    from turnledger.plans.rebuild import LeafState, extract_in_order

    run = floors(spark, ["+", "+", "bad", "+"]).withColumn("_base", F.lit("sha256:base"))
    run = run.unionByName(run.withColumn("chat_id", F.lit("other")).where("content = '+'"))
    before = spark.createDataFrame([("c", "b", "/story/count", '"4"')], "chat_id string, branch_id string, path string, value string")
    made = spark.createDataFrame([("none", "n", "x", None, None)], "floor_id string, node_id string, previous_state_fingerprint string, path string, value string")
    found = extract_in_order(run, before, made, counter(f"{folder}-calls"), attempts=2).collect()
    got = {(r.chat_id, r.message_index): (r.attempts, r.error, r.value) for r in found}
    assert got == {("c", 1): (1, None, '"5"'), ("c", 2): (1, None, '"6"'), ("c", 3): (2, "no", None), ("other", 1): (1, None, '"1"'), ("other", 2): (1, None, '"2"'), ("other", 4): (1, None, '"3"')}

    # The walk's fingerprint is the one that nodes carry.
    state, pairs = LeafState(), [("/a", '"1"'), ("/b", '[{"x":1,"source":{"y":[2]}}]'), ("/a", '"2"'), ("/source", '"left out"')]
    rows = [("c", "b", i, p, v) for i, (p, v) in enumerate(pairs)]
    log = spark.createDataFrame(rows, "chat_id string, branch_id string, seq long, path string, value string")
    want = {r.seq: r.state_fingerprint for r in leaf_fingerprints(leaf_changes(log), log.select("chat_id", "branch_id", "seq")).collect()}
    for i, (p, v) in enumerate(pairs):
        state.put(p, v)
        assert state.fingerprint() == want[i]


def test_a_round_reads_its_tables_a_bounded_number_of_times(spark, folder, monkeypatch):
    """Ordered scans start from written tables: none is computed anew inside of the next."""
    leaves, parquet = {}, DataFrameWriter.parquet

    def counted(self, path, *args, **options):
        plan = self._df._jdf.queryExecution().analyzed()
        leaves[path.rsplit("/", 1)[1]] = plan.collectLeaves().size()
        return parquet(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    texts = ["age=1", "age=2", "two", "none"]
    none = (spark.createDataFrame([], NODES), spark.createDataFrame([], PATCHES))
    done = rebuild_until_valid(floors(spark, texts), *none, age_reader(), "p1", folder, first_block=8)
    assert done.left.count() == 0 and done.nodes.count() == 4
    assert leaves["new_nodes"] <= 8 and leaves["new_deltas"] <= 8 and leaves["states"] <= 24


def stream_of(spark, frame, path, files=3):
    frame.repartition(files).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_floors_equal_the_batch(spark, folder):
    rows = [("c", "b", i, None, f"text {i % 7}", "pending", f"2026-01-0{1 + i % 3}") for i in range(40)] + [("c", "b", -1, None, "bad", "pending", "2026-01-01")]
    frame = spark.createDataFrame(rows, "chat_id string, branch_id string, message_index int, swipe_id int, content string, status string, u string").withColumn("updated_at", F.col("u").cast("timestamp")).drop("u")
    twice = frame.unionByName(frame.withColumn("status", F.lit("synced")).withColumn("updated_at", F.lit("2026-02-01").cast("timestamp")))
    query = ingest.start_ingest(stream_of(spark, twice, f"{folder}/in", 4), f"{folder}/out", f"{folder}/cp", available_now=True)
    query.awaitTermination()
    got = ingest.read_floors(spark, f"{folder}/out").collect()
    assert len(got) == 40 and {r.status for r in got} == {"synced"}
    assert len({r.floor_id for r in got}) == 40
    assert spark.read.parquet(f"{folder}/out/rejects").select("reason").distinct().count() == 1
    # An epoch that runs again leaves the same table.
    ingest.floor_writer(f"{folder}/out")(frame, 0)
    assert ingest.read_floors(spark, f"{folder}/out").count() == 40
    ingest.compact(spark, f"{folder}/out", f"{folder}/small")
    assert ingest.read_floors(spark, f"{folder}/small").count() == 40


def test_fold_waits_for_missing_floors(spark, folder):
    patches = ['{"/a": "1"}', '{"/b": "2", "/a": "1"}', '{"/a": null}', '{"/a": "3", "/b": "2"}']
    rows = [("c", "b", s, p) for s, p in enumerate(patches)] + [("d", "b", 1, patches[0])]
    frame = spark.createDataFrame(rows, "chat_id string, branch_id string, seq bigint, patches string")
    ordered = frame.orderBy(F.desc("seq")).collect()
    for n, row in enumerate(ordered):
        spark.createDataFrame([row], frame.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    query = fold.fold_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").select("chat_id", "seq", "op", "path", "old_value", "new_value").collect())
    assert got == [
        ("c", 0, "add", "/a", None, "1"), ("c", 1, "add", "/b", None, "2"),
        ("c", 2, "remove", "/a", "1", None), ("c", 3, "add", "/a", None, "3"),
    ]


def test_index_and_embeddings_follow_changes(spark, folder):
    schema = "chat_id string, branch_id string, memory_id string, start_floor bigint, title string, summary string, tags array<string>, character_ids array<string>, plotline_ids array<string>, stale boolean"
    def memory(i, text, stale=False):
        return ("c", "b", f"m{i}", i, None, text, [], [], [], stale)
    first = spark.createDataFrame([memory(i, f"gate word{i}") for i in range(6)], schema)
    second = spark.createDataFrame([memory(1, "wall"), memory(2, "gate word2", True), memory(9, "gate new")], schema)
    write = maintain.index_writer(folder)
    calls = []
    def encode(texts):
        return hashing_encoder(4)(texts)
    embed = maintain.embedding_writer(folder, encode, "s1")
    for epoch, df in enumerate((first, second)):
        write(df, epoch)
        embed(df, epoch)
    now = spark.createDataFrame([memory(i, f"gate word{i}") for i in (0, 3, 4, 5)] + [memory(1, "wall"), memory(9, "gate new")], schema)
    queries = spark.createDataFrame([("c", "b", "q", "gate wall")], "chat_id string, branch_id string, query_id string, text string")
    kept = bm25.search_index(*maintain.read_index(spark, folder), queries).select("memory_id", "rank", F.round("score", 9)).collect()
    fresh = bm25.bm25_topk(now, queries).select("memory_id", "rank", F.round("score", 9)).collect()
    assert sorted(kept) == sorted(fresh)
    assert {r.memory_id for r in maintain.read_embeddings(spark, folder).collect()} == {"m0", "m1", "m3", "m4", "m5", "m9"}


def test_published_tables_switch_as_a_whole(spark, folder):
    root = f"{folder}/t"
    empty = spark.createDataFrame([], "id bigint")
    assert tables.read_current_or(spark, root, empty).count() == 0
    tables.publish(spark.range(3), root)
    before = tables.read_current(spark, root)
    tables.publish(before.filter("id > 0"), root)
    assert tables.read_current(spark, root).count() == 2
    assert before.count() == 3
