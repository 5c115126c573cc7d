"""Cases beyond the supplied tables: deep documents, escaped ids, whole texts, late versions."""

import json
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnledger.functions.keys import vector_space_fingerprint
from turnledger.functions.parse import canonical_base_url, path_exists
from turnledger.functions.text import regex_summary
from turnledger.operators import chain, fusion, memory, merge, overrides, pack, quality, state_log
from turnledger.operators.bm25 import SCOPE
from turnledger.sources import tables
from turnledger.streaming import fold, ingest, maintain

ROW = "chat_id string, branch_id string, path string, kind string, value string"


def one_column(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(make(F.col("v"))).collect()]


def test_documents_are_opened_to_the_bottom(spark):
    deep = value = {}
    for i in range(12):
        value["k"] = {} if i < 11 else "end {[\\\" "
        value = value["k"]
    docs = spark.createDataFrame([(1, json.dumps(deep)), (2, "{}"), (3, None), (4, "no json")], "id int, doc string")
    rows = state_log.flatten_documents(docs, ["id"], "doc").collect()
    assert {r.path for r in rows if r.id == 1} == {"/k" * i for i in range(13)}
    assert [r.value for r in rows if r.path == "/k" * 12] == [json.dumps("end {[\\\" ")]
    assert [r.path for r in rows if r.id == 2] == [""]


@pytest.mark.parametrize("text", ["x\n", "\ty", "é \u0001", "a\\", '\\"', "[{"])
def test_documents_with_escapes_open_to_the_bottom(spark, text):
    deep = {"t": text, "b": {"c": {"d": {"e": 1}}}, text: text}
    docs = spark.createDataFrame([(json.dumps(deep),)], "doc string")
    rows = {r.path: r.value for r in state_log.flatten_documents(docs, [], "doc").collect()}
    assert rows["/b/c/d/e"] == "1" and rows["/b/c/d"] is None


def test_volatile_members_in_lists_do_not_count(spark):
    def state(n, at, sources):
        items = [{"id": "p", "updatedAt": at, "sourceFloorIds": sources}, {"source": {"x": 1}} if False else {"source": at, "t": "a,\"updatedAt\":1"}]
        return (str(n), "b", "/story/plotlines", "value", json.dumps(items, sort_keys=True, separators=(",", ":")))

    rows = [state(1, "x", ["f]1"]), state(2, None, []), ("3", "b", "/story/plotlines", "value", '[{"id":"q"}]'), ("4", "b", "/story/now/updatedAt", "value", '"x"')]
    got = {r.chat_id: r.state_fingerprint for r in state_log.state_fingerprints(spark.createDataFrame(rows, ROW), SCOPE).collect()}
    assert got["1"] == got["2"] != got["3"]
    assert got["4"] == state_log.EMPTY_FINGERPRINT


def test_empty_snapshots_are_not_missing(spark):
    rows = spark.createDataFrame([("3", "b", "/a", "value", "1")], ROW)
    expected = spark.createDataFrame(
        [("1", "b", state_log.EMPTY_FINGERPRINT), ("2", "b", "sha256:x"), ("3", "b", state_log.EMPTY_FINGERPRINT)],
        "chat_id string, branch_id string, state_fingerprint string",
    )
    got = {r.chat_id: r.reason for r in state_log.verify_snapshots(expected, rows, SCOPE).collect()}
    assert got == {"2": "snapshot is missing", "3": "snapshot does not hash to its fingerprint"}


def test_escaped_ids_stay_escaped(spark):
    rows = spark.createDataFrame([("c", "b", "/profiles/ a~1b /basic/x~1y~0", "value", "1")], ROW)
    out = quality.normalize_snapshot_rows(rows, SCOPE, F.lit("b")).collect()
    assert [r.path for r in out] == ["/profiles/a~1b/basic/x~1y~0"]
    base = spark.createDataFrame([], ROW)
    patch = spark.createDataFrame([("c", "b", 1, "/profiles/a~1b/basic/age", "1")], "chat_id string, branch_id string, seq int, path string, value string")
    got = {r.path: r.value for r in merge.merge_patches(base, patch).collect()}
    assert got == {"/profiles/a~1b/basic/age": "1", "/profiles/a~1b/canonicalName": '"a/b"'}


def test_overrides_replace_objects_whole(spark):
    rows = spark.createDataFrame(
        [("c", "b", p, k, v) for p, k, v in [("/profiles/x/affinity", "object", None), ("/profiles/x/affinity/inner", "value", "1"), ("/profiles/x/name", "value", '"n"'), ("/story/now", "object", None), ("/story/now/time", "value", '"t"')]],
        ROW,
    )
    events = spark.createDataFrame(
        [("c", "b", "/profiles/x/affinity", "replace", "value", '{"outer":{"v":2}}'), ("c", "b", "/story/now", "remove", None, None)],
        "chat_id string, branch_id string, path string, op string, kind string, value string",
    )
    got = {(r.path, r.kind, r.value) for r in overrides.apply_overrides(rows, events).collect()}
    assert got == {("/profiles/x/name", "value", '"n"'), ("/profiles/x/affinity", "object", None), ("/profiles/x/affinity/outer", "object", None), ("/profiles/x/affinity/outer/v", "value", "2")}


def test_sources_of_an_item_are_bounded_by_the_caller(spark):
    before = spark.createDataFrame([("c", "i", "old", [f"f{i}" for i in range(60)])], "k string, id string, content string, source_ids array<string>")
    new = spark.createDataFrame([("c", "i", "new", "f99")], "k string, id string, content string, source_id string")
    for limit, size in ((50, 50), (None, 61), (3, 3)):
        ids = merge.merge_collection(before, new, ["k"], limit).first().source_ids
        assert len(ids) == size and ids[-1] == "f99"


@pytest.mark.parametrize(("doc", "path", "found"), [('{"a":{"0":1}}', "a.0", True), ('{"a":[1]}', "a[0]", True), ('{"a":[1]}', "a[1]", False), ('{"a":[[{"b":0}]]}', "a[0].0.b", True), ('{"a":null}', "a", False), ('{"a":"x"}', "a.0", False)])
def test_numbers_name_members_or_places(spark, doc, path, found):
    assert one_column(spark, [doc], lambda v: path_exists(v, F.lit(path))) == [found]


def test_invalid_urls_do_not_share_a_space(spark):
    def key(v):
        return vector_space_fingerprint(F.lit("openai"), canonical_base_url(v), F.create_map(F.lit("a"), F.lit("b")), F.lit("m"), v)

    one, two, three = one_column(spark, ["ftp://x", " ftp://y ", "ftp://y"], key)
    assert one != two == three


def test_patterns_are_those_of_the_engine(spark):
    text = "x <s>body</s>"
    assert one_column(spark, [text], lambda v: regex_summary(v, "<s>(?<body>.*)</s>")) == ["body"]
    for bad in ("<s>(?P<body>.*)</s>", "(", " "):
        assert one_column(spark, [text], lambda v, p=bad: regex_summary(v, p)) == [None]
    long = "(?:" + "|".join(f"no{i}" for i in range(400)) + "|<s>)(.*)</s>"
    assert one_column(spark, [text], lambda v: regex_summary(v, long)) == ["body"]


def test_windows_listings_and_summaries_are_whole(spark):
    floors = spark.createDataFrame([("c", "b", i, f"t{i}") for i in range(40)], "chat_id string, branch_id string, message_index int, content string")
    asked = spark.createDataFrame([("c", "b", "q", None)], "chat_id string, branch_id string, query_id string, user_index int")
    got = pack.recent_window(asked, floors, 25)
    assert sorted(r.message_index for r in got.collect()) == list(range(15, 40))
    results = spark.range(1200).selectExpr("'c' chat_id", "'b' branch_id", "'f' floor_id", "'succeeded' status", "id message_index", "id created_at")
    assert chain.list_results(results, "c").count() == 1200
    assert chain.list_results(results, "c", limit=7).count() == 7
    text = " ".join(map(str, range(50)))
    out = memory.extractive_summariser([{"batch_start_floor": 1, "batch_end_floor": 1, "floors": [{"content": text}]}])
    assert json.loads(out[0])["slices"][0]["summary"] == text


def test_reranker_reads_whole_texts_and_fails_by_query(spark):
    rows = [("c", "b", q, f"m{i}", q, "d" * 5000 + str(i)) for q in ("good", "bad") for i in range(3)]
    pool = spark.createDataFrame(rows, "chat_id string, branch_id string, query_id string, memory_id string, query_text string, document string")

    def scorer(queries, documents):
        if queries.iloc[0] == "bad":
            raise ValueError("no")
        return documents.str.len()

    got = {(r.query_id, r.memory_id): (r.rerank_score, r.error) for r in fusion.score_pool(pool.coalesce(1), scorer).collect()}
    assert got["good", "m1"] == (5001.0, None) and got["bad", "m1"] == (None, "no")
    cut = fusion.score_pool(pool.filter("query_id = 'good'"), scorer, max_chars=10).collect()
    assert {r.rerank_score for r in cut} == {10.0}


def test_one_floor_for_null_and_zero_swipes(spark, folder):
    rows = [("c", "b", 1, None, "t", "pending", False, "2026-01-01"), ("c", "b", 1, 0, "t", "synced", True, "2026-01-02")]
    df = spark.createDataFrame(rows, "chat_id string, branch_id string, message_index int, swipe_id int, content string, status string, active boolean, u string").withColumn("updated_at", F.col("u").cast("timestamp")).drop("u")
    write = ingest.floor_writer(folder)
    write(df, 0)
    got = ingest.read_floors(spark, folder).collect()
    assert [(r.status, r.active, r.created_at.day, r.updated_at.day) for r in got] == [("synced", False, 1, 2)]
    ingest.compact(spark, folder, f"{folder}/small")
    assert ingest.read_floors(spark, f"{folder}/small").collect() == got


def test_streamed_fold_equals_the_batch_for_nested_paths(spark, folder):
    patches = [{"/a": "1"}, {"/a/x": "2", "/a/y": "3"}, {"/a": None}, {"/a/y": "4", "/ab": "5"}, {"/a": "6"}, {"/a/z": "7"}, {"/a/z": None, "/ab": None}]
    frame = spark.createDataFrame([("c", "b", s, json.dumps(p)) for s, p in enumerate(patches)], "chat_id string, branch_id string, seq bigint, patches string")
    frame.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
    query = fold.fold_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.parquet(f"{folder}/out").selectExpr("chat_id", "branch_id", "seq", "case when op = 'remove' then op else 'replace' end op", "path", "case when op <> 'remove' then 'value' end kind", "new_value value")
    log = [("c", "b", s, "remove" if v is None else "replace", p, None if v is None else "value", v) for s, x in enumerate(patches) for p, v in x.items()]
    batch = spark.createDataFrame(log, "chat_id string, branch_id string, seq bigint, op string, path string, kind string, value string")
    for at in range(len(patches)):
        one, two = ({(r.path, r.value) for r in state_log.latest_state(d.filter(F.col("seq") <= at)).collect()} for d in (changes, batch))
        assert one == two, at
    assert {(r.path, r.value) for r in state_log.latest_state(batch).collect()} == {("/a", "6")}


def test_the_newest_version_of_a_micro_batch_wins(spark):
    rows = [("c", "b", "m", v, f"text {v}") for v in (2, 3, 1)] + [("c", "b", "n", 1, "x"), ("c", "b", "n", 1, "y")]
    df = spark.createDataFrame(rows, "chat_id string, branch_id string, memory_id string, version int, summary string")
    for parts in (1, 5):
        got = {r.memory_id: r.summary for r in maintain.newest_versions(df.repartition(parts), "version").collect()}
        assert got["m"] == "text 3"
        first = got["n"] if parts == 1 else first
        assert got["n"] == first


def test_readers_see_one_set_of_tables(spark, folder):
    def frames(n):
        return {name: (spark.range(n).withColumn("made", F.lit(n)), None, None) for name in ("x", "y")}

    tables.publish_tables(frames(1), folder)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            got = tables.read_tables(spark, folder)
            seen.append(tuple(got[n].count() for n in ("x", "y")))

    reader = threading.Thread(target=read)
    reader.start()
    for n in (2, 3, 4):
        tables.publish_tables(frames(n), folder)
    stop.set()
    reader.join()
    assert seen and all(a == b for a, b in seen)
    assert tables.read_current(spark, f"{folder}/y").count() == 4
    tables.publish_tables({"x": (spark.range(9), None, None)}, folder)
    assert tables.read_current(spark, f"{folder}/x").count() == 9 and tables.read_current(spark, f"{folder}/y").count() == 4
