"""Scores added up where a document's postings lie, and state lookups that do not follow the seqs."""

import os

import pytest
from pyspark.sql import functions as F

from tests.test_text_and_search import MEMORY, QUERIES
from turnledger.operators import bm25, blockmax, scoring, state_log
from turnledger.operators import checkpoints as cp
from turnledger.operators.bm25 import SCOPE

WORDS = ["gate", "road", "river", "king", "dinner"]


def corpus(spark):
    rows = [("c", "b", f"m{i}", i, WORDS[i % 5], " ".join(WORDS[: 1 + i % 5] * (1 + i % 3)), [], i % 31 == 0) for i in range(400)]
    rows += rows[5:9]  # rows that come twice
    rows += [("c", "b", None, 7, None, "gate king", [], False), ("c", "b", "late", None, None, "road road", [], False)]
    rows += [("c", "other", f"o{i}", i, None, "gate", [], False) for i in range(30)]
    return spark.createDataFrame(rows, MEMORY)


def asked(spark):
    texts = ["gate road", "king", "river dinner gate", "nothing", "", "gate"]
    return spark.createDataFrame([("c", b, str(i), t) for b in ("b", "other", "none") for i, t in enumerate(texts)], QUERIES)


def by_hand(spark):
    """All pairs by joins, as the scores are defined."""
    memories, queries = corpus(spark), asked(spark)
    postings, lengths = bm25.build_index(memories)
    terms, stats = bm25.query_terms(queries), bm25.corpus_stats(lengths)
    weights = terms.join(bm25.document_frequency(postings), [*SCOPE, "term"]).join(stats, SCOPE)
    idf = F.log(1.0 + (F.col("doc_count") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1.2 * (0.25 + 0.75 * F.col("length") / F.col("avg_length"))
    part = idf * (F.col("tf") * 2.2 / (F.col("tf") + norm))
    keys = [*SCOPE, "query_id", "memory_id", "start_floor"]
    return postings.join(weights, [*SCOPE, "term"]).groupBy(*keys).agg(F.sum(part).alias("score"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns, F.round("score", 9)).collect()), key=str)


PAIR = ["branch_id", "query_id", "memory_id", "start_floor"]


def test_scores_equal_the_joins_and_lists_hold_the_best(spark, monkeypatch):
    memories, queries = corpus(spark), asked(spark)
    postings, lengths = bm25.build_index(memories)
    terms, stats = bm25.query_terms(queries), bm25.corpus_stats(lengths)
    every = by_hand(spark).persist()
    assert rows(bm25.score(postings, stats, terms), *PAIR) == rows(every, *PAIR)
    keys, floors = [*SCOPE, "query_id"], [F.asc("start_floor"), F.asc("memory_id")]
    lists = [bm25.Best(3), bm25.Best(2, by_floor=True, only="start_floor % 3 = 1")]
    some = bm25.score(postings, stats, terms, lists)
    few = some.count()
    assert few < every.count() / 5
    third = "start_floor % 3 = 1"
    for order, k, where in ((bm25.by_score(), 3, "true"), (floors, 2, third)):
        got, want = (bm25.top_k(x.where(where), keys, order, k) for x in (some, every))
        assert rows(got, *PAIR, "rank") == rows(want, *PAIR, "rank")
    want = rows(bm25.top_k(every, keys, bm25.by_score(), 4), *PAIR, "rank")
    assert rows(bm25.bm25_topk(memories, queries, 4), *PAIR, "rank") == want
    # Queries in blocks, pairs and cells a few at a time: the same rows.
    monkeypatch.setattr(scoring, "TERM_ROWS", 4)
    assert rows(bm25.search_index(postings, lengths, queries, 4), *PAIR, "rank") == want


def test_one_pass_over_the_texts(spark, folder):
    """Was: texts were dealt, and then each of their terms was shuffled; lengths read them again."""
    memories = corpus(spark).withColumn("chat_id", F.lit("c"))
    plan = bm25.build_index(memories)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plain = [bm25.build_index(memories), blockmax.build_blocks(memories, 16)]
    for i, build in enumerate((bm25.build_index, lambda m, written: blockmax.build_blocks(m, 16, written))):
        made = build(memories, written=lambda df: bm25.staged(df, f"index{i}"))
        for got, want in zip(made, plain[i]):
            columns = sorted(want.columns)
            assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
            assert "RegExp" not in got._jdf.queryExecution().optimizedPlan().toString()


LOG = "chat_id string, branch_id string, seq long, op string, path string, kind string, value string"
FAR = 10**12


def sparse(spark, n):
    """A chat whose seqs are far apart: as many points, but no segment has two."""
    made = [("a", "m", i * FAR, "remove" if i % 7 == 6 else "replace", f"/p{i % 3}" if i % 5 else "/p0/x", "value", str(i)) for i in range(n)]
    return spark.createDataFrame(made, LOG), made


def folded(made, at):
    state = {}
    for _, _, seq, op, path, kind, value in made:
        if seq <= at:
            state = {p: v for p, v in state.items() if p != path and not p.startswith(path + "/")}
            if op != "remove":
                state[path] = value
    return state


def states(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["path"]] = r["value"]
    return out


@pytest.mark.parametrize("n", [20, 300])
def test_states_of_a_sparse_chat(spark, n):
    """Was: a version was listed under every segment of seqs that it is alive in."""
    events, made = sparse(spark, n)
    points = events.select(*SCOPE, F.col("seq").cast("string").alias("query_id"), F.col("seq").alias("at_seq"))
    got = states(state_log.state_at(state_log.state_versions(events), points, state_log.last_seq(events), 1000))
    for _, _, seq, *_ in made[:: max(1, n // 40)]:
        assert got.get(str(seq), {}) == folded(made, seq), seq


def test_replay_of_a_sparse_chat_without_checkpoints(spark, folder):
    """Was: a point without a checkpoint listed every segment before it."""
    events, made = sparse(spark, 12)
    cp.append_log(events, folder, 50)
    points = events.select(*SCOPE, F.col("seq").cast("string").alias("query_id"), F.col("seq").alias("at_seq"))
    got = states(cp.replay_points(spark, folder, points, 50, 64))
    for _, _, seq, *_ in made:
        assert got.get(str(seq), {}) == folded(made, seq), seq


def test_rows_without_a_path_replace_each_other_only(spark, folder):
    made = [("", "1"), (None, "2"), ("/a", "3"), (None, "4"), ("", "5")]
    events = spark.createDataFrame([("a", "m", i, "replace", p, "value", v) for i, (p, v) in enumerate(made)], LOG)
    cp.append_log(events, folder, 50)
    points = events.select(*SCOPE, F.col("seq").cast("string").alias("query_id"), F.col("seq").alias("at_seq"))
    got = states(cp.replay_points(spark, folder, points, 50, 64))
    assert got == {"0": {"": "1"}, "1": {"": "1", None: "2"}, "2": {"": "1", None: "2", "/a": "3"}, "3": {"": "1", None: "4", "/a": "3"}, "4": {"": "5", None: "4"}}


def test_a_long_log_has_few_partitions(spark, folder):
    """Was: a folder and a file for each segment, which the driver lists and holds."""
    events = spark.range(3000).select(
        (F.col("id") % 40).cast("string").alias("chat_id"), F.lit("m").alias("branch_id"), (F.col("id") * 10).alias("seq"),
        F.lit("replace").alias("op"), F.lit("/p").alias("path"), F.lit("value").alias("kind"), F.col("id").cast("string").alias("value"),
    )
    cp.append_log(events, folder, 10)
    assert len([d for d in os.listdir(f"{folder}/log") if d.startswith("segment=")]) < 64 + 32 * 7
    marks = events.where("seq % 4000 = 0").select(*SCOPE, "seq")
    cp.write_checkpoints(events, marks, folder, 10, 64)
    end = events.where("seq >= 29600").select(*SCOPE, F.lit("end").alias("query_id"), F.col("seq").alias("at_seq"))
    got = {r["chat_id"]: r["value"] for r in cp.replay_points(spark, folder, end, 10, 64).collect()}
    assert got == {str(i % 40): str(i) for i in range(2960, 3000)}
    asked = marks.where("seq = 28000").select(*SCOPE, F.lit("q").alias("query_id"), F.lit(28010).cast("long").alias("at_seq"))
    read = cp.replay_plan(spark, folder, asked, 10, 64)[2]
    assert 0 < read.count() < 3000 / 20
