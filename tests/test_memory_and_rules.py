import json

from pyspark.sql import functions as F

from turnledger.functions import parse
from turnledger.operators import context as cx
from turnledger.operators import memory as mem
from turnledger.operators import merge as mg
from turnledger.operators import overrides as ov
from turnledger.operators import quality as ql

BATCH = (
    "batch_id string, chat_id string, branch_id string, batch_start_floor bigint, batch_end_floor bigint, "
    "batch_dependency_fingerprint string, stale boolean, created_at int, updated_at int"
)


def nodes(spark, n, skip=()):
    rows = [
        ("c", "b", i * 2, f"f{i}", f"n{i}", f"s{i}", "stale" if i in skip else "synced") for i in range(1, n + 1)
    ]
    return spark.createDataFrame(
        rows, "chat_id string, branch_id string, message_index bigint, floor_id string, state_node_id string, state_fingerprint string, status string"
    )


def spans(df):
    return sorted((r.batch_start_floor, r.batch_end_floor) for r in df.collect())


def test_only_complete_groups_of_synced_nodes(spark):
    assert spans(mem.expected_ranges(nodes(spark, 29), 30)) == []
    assert spans(mem.expected_ranges(nodes(spark, 61), 30, size=8)) == [(1, 30), (31, 60)]
    assert spans(mem.expected_ranges(nodes(spark, 61, skip={5, 6}), 30, size=8)) == [(1, 30)]


def test_changed_interval_makes_all_batches_stale(spark):
    rows = [("a", "c", "b", 1, 30, "d", False, 1, 1), ("b", "c", "b", 31, 60, "d", False, 1, 1), ("o", "x", "b", 1, 30, "d", False, 1, 1)]
    batches = spark.createDataFrame(rows, BATCH)
    expected = mem.expected_ranges(nodes(spark, 61), 20)
    assert {r.batch_id for r in mem.mismatched_batches(batches, expected).collect()} == {"a", "b"}
    assert spans(mem.missing_ranges(batches, expected)) == [(1, 20), (21, 40), (41, 60)]
    assert mem.mismatched_batches(batches, mem.expected_ranges(nodes(spark, 61), 30)).count() == 0


def test_going_back_to_an_earlier_text_reuses_its_batch(spark):
    rows = [("A", "c", "b", 1, 30, "depA", True, 1, 1), ("B", "c", "b", 1, 30, "depB", False, 2, 2), ("E", "c", "b", 31, 60, "depE", True, 2, 2)]
    batches = spark.createDataFrame(rows, BATCH)
    slices = spark.createDataFrame([("A",), ("B",)], "batch_id string")
    wanted = batches.filter("batch_id in ('A', 'E')").select(*mem.RANGE, "batch_dependency_fingerprint")
    found = mem.reusable_batches(wanted, batches, slices)
    assert {r.batch_start_floor: r.batch_id for r in found.collect()} == {1: "A", 31: None}
    after = mem.activate_batches(batches, found.filter("batch_id is not null"))
    assert {r.batch_id: r.stale for r in after.collect()} == {"A": False, "B": True, "E": True}


def test_one_survivor_per_range_with_ties(spark):
    rows = [("A", "c", "b", 1, 30, "", False, 1, 1), ("B", "c", "b", 1, 30, "", False, 2, 1), ("C", "c", "b", 1, 30, "", False, 1, 3), ("D", "c", "b", 31, 60, "", False, 1, 1), ("E", "c", "b", 31, 60, "", True, 1, 1)]
    got = mem.single_survivor(spark.createDataFrame(rows, BATCH)).collect()
    assert {r.batch_id for r in got if not r.stale} == {"C", "E"}


def test_range_inputs_report_what_is_missing(spark):
    floors = spark.createDataFrame([(f"f{i}", "c", f"t{i}", i != 4) for i in range(1, 11)], "floor_id string, chat_id string, content string, active boolean")
    deltas = spark.createDataFrame([("n1", "d1"), ("n3", "d3")], "state_node_id string, delta string")
    ranges = spark.createDataFrame([("c", "b", 1, 3), ("c", "b", 4, 5), ("c", "b", 9, 12), ("c", "b", 3, 2)], "chat_id string, branch_id string, batch_start_floor bigint, batch_end_floor bigint")
    rows = {r.batch_start_floor: r for r in mem.range_inputs(ranges, nodes(spark, 10), floors, deltas).collect()}
    assert [f.content for f in rows[1].floors] == ["t1", "t2", "t3"] and rows[1].deltas == ["d1", "d3"]
    assert rows[1].end_state_node_id == "n3" and rows[1].reason is None
    assert rows[4].reason == "source floors unavailable"
    assert rows[9].reason == "range requires synchronized floors"
    assert rows[3].reason == "invalid summary range"


def test_json_extraction_reasons(spark):
    texts = {
        'x <think>{"no":1}</think> ```json\n{"a": 1,}\n``` tail': '{"a":1}',
        "{“a”: [1,2,],}": '{"a":[1,2]}',
        'say {"a": {"b": 2}} done': '{"a":{"b":2}}',
        "<thinking> never closed {}": "unterminated reasoning block",
        "  ": "empty",
        "[1]": "not an object",
        "{ oops": "not valid JSON",
    }
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = {r.raw: r.json or r.reason for r in parse.extract_json_objects(df, "raw").collect()}
    assert got == texts


def test_json_is_the_whole_text_or_its_object(spark):
    texts = {
        '4703 and more {"a": 1} tail': '{"a":1}',
        '[1] then {"a": 2}': '{"a":2}',
        '"quoted", {"a": 3}': '{"a":3}',
        'true {"a": 4} false': '{"a":4}',
        "12 monkeys": "not valid JSON",
        "12, 13": "not valid JSON",
        "null": "not an object",
        "12": "not an object",
        '{"a": 5} {"b": 6}': "not valid JSON",
    }
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = {r.raw: r.json or r.reason for r in parse.extract_json_objects(df, "raw").collect()}
    assert got == texts


def test_base_urls(spark):
    urls = {
        "https://Api.Example.com/": "https://api.example.com/v1",
        "http://h:80/x/chat/completions/": "http://h/x",
        "https://h:8443//": "https://h:8443/v1",
        "https://h/v2?x=1#y": "https://h/v2",
        "ftp://h": None,
        " ": None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in df.select("u", parse.canonical_base_url(F.col("u")).alias("c")).collect()} == urls


def test_fields_below_open_members_are_not_checked(spark):
    docs = spark.createDataFrame([(1, '{"profiles":{"a":{"nsfw":{"x":{"y":[1]}}}}}'), (2, "nope")], "id int, doc string")
    found = ql.candidate_violations(docs, ["id"], "doc")
    assert [(r.id, r.reason) for r in found.collect()] == [(2, "is not JSON")]


def test_locks_cover_equal_under_and_above(spark):
    rows = [(1, "/profiles/a/basic/age"), (2, "/profiles/a/basic"), (3, "/profiles/a/basic/age/x"), (4, "/profiles/a/basic/ages"), (5, "/profiles/b/basic/age")]
    writes = spark.createDataFrame(rows, "id int, path string")
    locks = spark.createDataFrame([(i, "profiles.a.basic.age") for i in range(1, 6)], "id int, locked_path string")
    assert {r.id for r in ql.locked_writes(writes, locks, ["id"]).collect()} == {1, 2, 3}


def test_merge_keeps_null_affinity_and_names_strangers(spark):
    rows = [
        (1, "/traces/bob/affinity/inner", "1"), (2, "/traces/bob/affinity/inner", "null"),
        (2, "/profiles/ann/basic/age", '"  "'), (3, "/profiles/ann/aliases", '[" Al ","Al"]'),
    ]
    patches = spark.createDataFrame([("c", "b", *r) for r in rows], "chat_id string, branch_id string, seq int, path string, value string")
    base = spark.createDataFrame([("c", "b", "/profiles/ann/canonicalName", '"Ann"')], "chat_id string, branch_id string, path string, value string")
    got = {r.path: r.value for r in mg.merge_patches(base, patches).collect()}
    assert got == {
        "/profiles/ann/canonicalName": '"Ann"', "/profiles/ann/aliases": '["Al"]',
        "/profiles/bob/canonicalName": '"bob"', "/traces/bob/affinity/inner": "null",
    }


def test_provenance_is_bounded(spark):
    ids = [f"s{i}" for i in range(50)]
    previous = spark.createDataFrame([("k", "x", "a", ids), ("k", "y", "a", ids)], "k string, id string, content string, source_ids array<string>")
    incoming = spark.createDataFrame([("k", "x", "b", "new"), ("k", "y", "a", "new"), ("k", "z", "c", "new")], "k string, id string, content string, source_id string")
    got = {r.id: r.source_ids for r in mg.merge_collection(previous, incoming, ["k"]).collect()}
    assert got["x"] == [*ids[1:], "new"] and got["y"] == ids and got["z"] == ["new"]


def test_override_then_restore(spark):
    rows = spark.createDataFrame([("c", "b", "/profiles/a/basic/age", "value", '"20"'), ("c", "b", "/profiles/a/lockedPaths", "value", '["aliases"]')], "chat_id string, branch_id string, path string, kind string, value string")
    edits = [
        (1, "profile", "a", "basic.age", '"21"', None), (2, "profile", "a", "basic.age", None, "lock"),
        (3, "profile", "a", "basic.age", None, "restore-ai"), (4, "profile", "new", "canonicalName", '""', None),
        (5, "story", None, "now.currentTime", '"Day 2"', None), (6, "trace", "a", "basic.age", None, "lock"),
    ]
    frame = spark.createDataFrame([("c", "b", *e) for e in edits], "chat_id string, branch_id string, edit_seq int, target string, entity_id string, field_path string, value string, action string")
    good, bad = ov.check_overrides(frame, rows)
    assert [r.reason for r in bad.collect()] == ["locks apply to profile fields"]
    after = ov.apply_overrides(rows, ov.override_events(good, rows))
    assert {r.path: r.value for r in after.collect()} == {
        "/profiles/a/basic/age": '"21"', "/profiles/a/lockedPaths": '["aliases"]',
        "/story/now/currentTime": '"Day 2"', "/profiles/new/sourcePriority/canonicalName": '"manual"',
    }


def test_wildcard_slot_hides_a_field_of_everyone(spark):
    key = ("c", "b", "q")
    fields = spark.createDataFrame([(*key, "profile", w, f, s) for w in "ab" for f, s in (("basic", "age"), ("lifeDetails", None))], "chat_id string, branch_id string, query_id string, domain string, character_id string, field string, sub_field string")
    slots = spark.createDataFrame([(*key, "profile", None, "basic", None, None), (*key, "profile", "b", "lifeDetails", None, None)], "chat_id string, branch_id string, query_id string, domain string, character_id string, field string, item_id string, semantic_key string")
    got = cx.visible_fields(fields, slots).collect()
    assert [(r.character_id, r.field) for r in got] == [("a", "lifeDetails")]


def test_summaries_become_memories(spark):
    floors = [{"floor_id": f"f{i}", "content": f"text {i}"} for i in range(1, 4)]
    raw = mem.extractive_summariser([{"batch_start_floor": 1, "batch_end_floor": 3, "floors": floors}])[0]
    two = json.loads(raw)["slices"] + [{"startFloor": 2, "endFloor": 3, "summary": "tail", "tags": ["x", "x", ""]}]
    outputs = spark.createDataFrame([("c", "b", 1, 3, "B1", json.dumps({"slices": two}))], "chat_id string, branch_id string, batch_start_floor bigint, batch_end_floor bigint, batch_id string, output string")
    slices, rejected = mem.parse_slices(outputs)
    assert rejected.count() == 0
    batches = spark.createDataFrame([("B1", ["f1", "f2", "f3"])], "batch_id string, source_floor_ids array<string>")
    got = {r.slice_id: (r.source_floor_ids, r.tags) for r in mem.memory_rows(slices, batches).collect()}
    assert got == {"B1:slice:1": (["f1", "f2", "f3"], []), "B1:slice:2": (["f2", "f3"], ["x"])}
