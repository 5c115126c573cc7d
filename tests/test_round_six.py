"""Findings of the third review: one test for each change."""

import numpy as np
import pandas as pd

from turnledger.operators import vectors as vec


def test_blocks_fill_over_batches_and_a_pair_of_blocks_is_one_frame():
    rng = np.random.default_rng(3)
    stored, asked = rng.normal(size=(700, 6)), rng.normal(size=(40, 6))
    stored[100:400] = stored[100]  # ties
    ids = [f"m{i}" for i in range(700)]

    def frames(rows, **columns):
        frame = pd.DataFrame({"chat_id": "c", "branch_id": "b", **columns, "vector": list(rows)})
        return (frame.iloc[i : i + 100].reset_index(drop=True) for i in range(0, len(frame), 100))

    blocks = list(vec._pack(["memory_id", "start_floor"])(frames(stored, memory_id=ids, start_floor=np.arange(700) % 7)))
    queries = list(vec._pack(["query_id"])(frames(asked, query_id=[f"q{i}" for i in range(40)])))
    assert len(blocks) == len(queries) == 1
    pair = pd.concat([blocks[0], queries[0][["query_id", "matrix"]].rename(columns={"matrix": "query_matrix"})], axis=1)
    for k in (1, 5, 310, 1 << 30):
        found = list(vec._best_pairs(k)(iter([pair])))
        assert len(found) == 1
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        scores = np.round(unit(asked) @ unit(stored).T, vec.SCORE_DECIMALS)
        got = found[0]
        for q in range(40):
            line = [(-s, i % 7, ids[i]) for i, s in enumerate(scores[q]) if s > 0]
            rows = got[got["query_id"] == f"q{q}"]
            assert sorted(line)[:k] == list(zip(-rows["score"], rows["start_floor"], rows["memory_id"]))


def test_prior_results_carry_what_is_asked_only(spark):
    from turnledger.operators.chain import prior_results

    rows = spark.createDataFrame(
        [("f", "r1", "succeeded", "{}", "d", 1, 5), ("f", "r2", "succeeded", "{}", "d", 2, 5), ("f", "r3", "failed", "{}", "d", 3, 9), ("g", "r4", "succeeded", None, "d", 1, 1)],
        "floor_id string, result_id string, status string, candidate string, dependency_fingerprint string, created_at long, finished_at long",
    )
    found = prior_results(rows, ["floor_id"], [])
    assert [(r.floor_id, r.result_id) for r in found.collect()] == [("f", "r2")]
    assert found.columns == ["floor_id", "result_id", "created_at", "finished_at"]
    assert prior_results(rows, ["floor_id"]).columns == rows.columns


class _State:
    """A map or value state that counts its calls."""

    def __init__(self):
        self.data, self.calls, self.value = {}, 0, None

    def __getattr__(self, name):
        self.calls += 1
        return {
            "containsKey": lambda k: k in self.data,
            "getValue": lambda k: self.data[k],
            "updateValue": self.data.__setitem__,
            "removeKey": lambda k: self.data.pop(k),
            "iterator": lambda: iter(list(self.data.items())),
            "clear": self.data.clear,
            "exists": lambda: bool(self.data) or self.value is not None,
            "get": lambda: self.value,
            "update": lambda v: setattr(self, "value", v),
        }[name]


def _folded(calls, monkeypatch, floors, cells):
    from turnledger.streaming import fold

    monkeypatch.setattr(fold, "HELD_FLOORS", floors)
    monkeypatch.setattr(fold.BatchCells.__init__, "__defaults__", (cells,))
    state = fold.PatchFold()
    tree, state.waiting, state.next = _State(), _State(), _State()
    state.tree = fold.PathTree(tree)
    out = []
    for rows in calls:
        batches = (pd.DataFrame(rows[i : i + 7], columns=["seq", "patches"]) for i in range(0, len(rows), 7))
        for found in state.handleInputRows(("c", "b"), batches, None):
            out += list(found.itertuples(index=False, name=None))
    return out, tree, state.waiting, state.next.value


def test_fold_turns_to_the_store_once_a_cell_not_once_a_patch(monkeypatch):
    import json
    import random

    rng = random.Random(4)
    floors = [(i, json.dumps({f"/{rng.choice('abc')}" + rng.choice(["", "/x", "/y"]): rng.choice([None, "1", "2"])})) for i in range(300)]
    mixed = rng.sample(floors, 300)
    calls = [mixed[:90], mixed[60:200], mixed[200:] + mixed[:20]]  # some come twice
    plain, tree, waiting, end = _folded([floors], monkeypatch, 1000, 1000)
    assert end == (300,) and waiting.calls < 5 and tree.calls < 60
    assert not [k for k in waiting.data]
    for limits in ((1000, 1000), (5, 3), (20, 1)):
        got, other, waiting, end = _folded(calls, monkeypatch, *limits)
        assert (got, other.data, waiting.data, end) == (plain, tree.data, {}, (300,))


def test_stable_characters_are_the_same_whichever_way_they_are_asked(spark):
    from pyspark.sql import functions as F

    from turnledger.functions.text import _UNSTABLE, NFKC_STABLE, tokenize

    chars = spark.range(1, 0x30000).filter("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert chars.filter(F.col("c").rlike(f"[^{NFKC_STABLE}]") != F.col("c").rlike(_UNSTABLE)).isEmpty()
    texts = spark.createDataFrame([("Ab1 é-x", ["ab1", "é", "x"]), ("中文 b", ["中", "文", "中文", "b"]), ("", [])], "t string, want array<string>")
    assert texts.filter(tokenize(F.col("t")) != F.col("want")).isEmpty()


def test_terms_of_a_document_are_counted_where_its_text_is(spark):
    from turnledger.operators import bm25

    rows = spark.createDataFrame([("c", "b", "m", 1, "x", "x y y", ["y"], [], [], False)] * 2, "chat_id string, branch_id string, memory_id string, start_floor long, title string, summary string, tags array<string>, character_ids array<string>, plotline_ids array<string>, stale boolean")
    terms = bm25.weighted_terms(rows)
    assert {r.term: r.tf for r in terms.collect()} == {"x": 8, "y": 8}
    assert terms._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hash") == 1


def test_pack_counts_come_with_the_candidates(spark):
    from turnledger.operators import pack

    keys = "chat_id string, branch_id string, query_id string, memory_id string, rank int"
    fixed = spark.createDataFrame([("c", "b", "q", "m1", 1), ("c", "b", "q", "m2", 2), ("c", "b", "r", "m1", 1)], keys)
    final = spark.createDataFrame([("c", "b", "q", "m2", 1), ("c", "b", "q", "m3", 2), ("c", "b", "q", "m4", 3)], keys)
    got = pack.merge_candidates(fixed, final, counts=True)
    assert {(r.query_id, *(r[n] for n in pack.COUNTS)) for r in got.collect()} == {("q", 2, 3), ("r", 1, 0)}
    assert got.count() == 5 and pack.merge_candidates(fixed, final).columns == [*pack.QUERY, "memory_id", "source", "ord"]


def test_small_batches_keep_smaller_settings(spark):
    from turnledger.llm import stages

    before = spark.conf.get(stages._BATCH)
    try:
        for had, now in (("10000", 1000), ("0", 1000), ("50", 50)):
            spark.conf.set(stages._BATCH, had)
            stages.small_batches(spark)
            assert int(spark.conf.get(stages._BATCH)) == now
    finally:
        spark.conf.set(stages._BATCH, before)
