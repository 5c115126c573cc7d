import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from turnledger.functions import text as tx
from turnledger.functions.keys import ancestors, join_pointer, split_pointer
from turnledger.operators import bm25, fusion, vectors
from turnledger.plans import recall as rc

MEMORY = (
    "chat_id string, branch_id string, memory_id string, start_floor bigint, title string, "
    "summary string, tags array<string>, stale boolean"
)
QUERIES = "chat_id string, branch_id string, query_id string, text string"


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()[0]


def test_tokens_of_mixed_text(spark):
    got = one(spark, tx.tokenize, "艾丽丝 Alice XML<hidden>")
    assert got == ["艾", "丽", "丝", "艾丽", "丽丝", "alice", "xml", "hidden"]
    assert one(spark, tx.tokenize, "x艾丽 １２ﬁ") == ["x艾丽", "12fi"]
    assert one(spark, tx.tokenize, "!!") == []


def test_stable_class_holds_only_unchanged_characters():
    ranges = re.findall(r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?", tx.NFKC_STABLE)
    for low, high in ranges:
        for code in range(int(low, 16), int(high or low, 16) + 1):
            char = chr(code)
            assert unicodedata.is_normalized("NFKC", char), hex(code)
            assert unicodedata.combining(char) == 0, hex(code)


@pytest.mark.parametrize(
    "text,tokens", [("", 0), ("a", 1), ("abcde", 2), ("记忆", 2), ("记忆 ab", 3), ("カナ한국", 4)]
)
def test_token_estimate(spark, text, tokens):
    assert one(spark, tx.estimate_tokens, text) == tokens


@pytest.mark.parametrize(
    "pattern,expected",
    [
        (r"<s>(.*?)</s>", "line one\nline two"),
        (r"(zz)?<s>", "<s>"),
        (r"([", None),
        ("  ", None),
        (r"absent", None),
    ],
)
def test_regex_summary(spark, pattern, expected):
    content = "x <s> line one\nline two </s>"
    assert one(spark, lambda c: tx.regex_summary(c, pattern), content) == expected


def test_unicode_trim_and_pointers(spark):
    assert one(spark, tx.trim_ws, "\u3000\u00a0 a b\ufeff\n") == "a b"
    assert one(spark, lambda c: join_pointer(F.array(c, F.lit("x/y~z"))), "a") == "/a/x~1y~0z"
    assert one(spark, split_pointer, "/a/x~1y~0z") == ["a", "x/y~z"]
    assert one(spark, split_pointer, "") == []
    assert one(spark, split_pointer, "bad") is None
    assert one(spark, ancestors, "/a/b/c") == ["", "/a", "/a/b"]
    assert one(spark, ancestors, "") == []


def docs(spark):
    rows = [
        ("c", "b", "a", 1, "The Gate", "Alice opened the ancient gate", ["ruins"], False),
        ("c", "b", "b", 1, "Dinner", "Bob cooked dinner", [], False),
        ("c", "b", "c", 1, "古老的门", "艾丽丝在古老的门前停下", [], False),
        ("c", "b", "old", 1, "Gate", "ancient gate gate gate", [], True),
        ("c", "other", "z", 1, None, "ancient gate elsewhere", [], False),
    ]
    return spark.createDataFrame(rows, MEMORY)


def ask(spark, *texts):
    return spark.createDataFrame([("c", "b", str(i), t) for i, t in enumerate(texts)], QUERIES)


def test_bm25_ranks_and_keeps_scopes_apart(spark):
    got = bm25.bm25_topk(docs(spark), ask(spark, "ancient gate", "艾丽丝 古老的门", "dinner", "nothing")).collect()
    best = {r.query_id: r.memory_id for r in got if r["rank"] == 1}
    assert best == {"0": "a", "1": "c", "2": "b"}
    assert {r.memory_id for r in got} <= {"a", "b", "c"}
    assert len([r for r in got if r.query_id == "2"]) == 1


def test_refreshed_index_equals_a_new_one(spark):
    before = docs(spark)
    postings, lengths = bm25.build_index(before)
    after = (
        before.withColumn("summary", F.when(F.col("memory_id") == "a", "unrelated replacement").otherwise(F.col("summary")))
        .withColumn("stale", F.col("stale") | (F.col("memory_id") == "b"))
        .withColumn("character_ids", F.array().cast("array<string>"))
        .withColumn("plotline_ids", F.array().cast("array<string>"))
    )
    full = before.withColumn("character_ids", F.array().cast("array<string>")).withColumn("plotline_ids", F.array().cast("array<string>"))
    indexed = full.filter("not stale").select(*bm25.SCOPE, "memory_id", bm25.memory_fingerprint().alias("content_key"))
    changes = bm25.index_changes(after, indexed)
    actions = {r.memory_id: r.action for r in changes.collect()}
    assert actions == {"a": "upsert", "b": "remove", "c": "keep", "z": "keep"}
    new = bm25.refresh_index(after, postings, lengths, changes)
    fresh = bm25.build_index(after)
    for left, right in zip(new, fresh):
        assert sorted(map(tuple, left.select(*sorted(left.columns)).collect())) == sorted(
            map(tuple, right.select(*sorted(right.columns)).collect())
        )


def test_scores_that_differ_in_their_last_bits_tie(spark):
    """Sums in another order: the earlier floor comes first, whichever sum is larger by a bit."""
    low, high = 0.1 + 0.2 + 0.3, 0.3 + 0.2 + 0.1
    assert low > high
    rows = [("late", 2, low), ("early", 1, high)]
    scored = spark.createDataFrame([("c", "b", "q", *r) for r in rows], "chat_id string, branch_id string, query_id string, memory_id string, start_floor int, score double")
    assert [r.memory_id for r in scored.orderBy(*bm25.by_score()).collect()] == ["early", "late"]
    fused = scored.withColumnRenamed("score", "rrf_score")
    assert [r.memory_id for r in fusion.rank_fused(fused, 2).orderBy("rrf_rank").collect()] == ["early", "late"]


RANKED = "chat_id string, branch_id string, query_id string, memory_id string, start_floor int, rank int, score double"


def ranked(spark, ids):
    return spark.createDataFrame(
        [("c", "b", "q", m, 1, i + 1, 1.0 - i / 10) for i, m in enumerate(ids)], RANKED
    )


def test_fusion_order_and_duplicates(spark):
    fused = fusion.fuse({"bm25": ranked(spark, "abc"), "embedding": ranked(spark, "cdac")}, 60)
    rows = fusion.rank_fused(fused, 10).orderBy("rrf_rank").collect()
    assert [r.memory_id for r in rows] == ["a", "c", "b", "d"]
    assert rows[1].ranks == {"bm25": 3, "embedding": 1}
    assert abs(rows[0].rrf_score - (1 / 61 + 1 / 63)) < 1e-12


def final(spark, ids, scores, **kw):
    fused = fusion.fuse({"bm25": ranked(spark, ids)})
    table = None
    if scores is not None:
        table = spark.createDataFrame(
            [("c", "b", "q", m, s) for m, s in scores.items()],
            "chat_id string, branch_id string, query_id string, memory_id string, rerank_score double",
        )
    rows = fusion.select_final(fused, table, **kw).orderBy("rank").collect()
    return [r.memory_id for r in rows], {r.rerank_status for r in rows}


def test_rerank_statuses(spark):
    scores = {"f": 0.9, "b": 0.8, "a": 0.1, "h": float("nan")}
    assert final(spark, "abcdefgh", None) == (list("abcdef"), {"disabled"})
    assert final(spark, "abcdefgh", None, enabled=True) == (list("abcdef"), {"not_configured"})
    assert final(spark, "abc", scores, enabled=True) == (list("abc"), {"skipped_within_final"})
    assert final(spark, "abcdefgh", scores, enabled=True) == (list("fbacde"), {"applied"})
    pool = final(spark, "abcdefgh", scores, enabled=True, candidates=4, final=3)
    assert pool == (["b", "a", "c"], {"applied"})


def test_vector_search_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    stored = [("c", "b", f"m{i}", int(i % 5), [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    stored += [("c", "b", f"copy{i}", 3, stored[7][4]) for i in range(40)]
    stored += [("c", "b", "short", 0, [1.0]), ("c", "b", "zero", 0, [0.0] * 8), ("c", "x", "far", 0, stored[0][4])]
    asked = [("c", "b", f"q{i}", [float(x) for x in rng.normal(size=8)]) for i in range(5)]
    asked.append(("c", "b", "copyq", stored[7][4]))
    schema = "chat_id string, branch_id string, memory_id string, start_floor int, vector array<double>"
    got = vectors.vector_topk(
        spark.createDataFrame(stored, schema).repartition(5),
        spark.createDataFrame(asked, "chat_id string, branch_id string, query_id string, vector array<double>"),
        7,
    ).collect()
    for _, _, query_id, q in asked:
        want = []
        for _, branch, m, floor, v in stored:
            if branch == "b" and len(v) == 8 and np.linalg.norm(v) > 0:
                s = round(float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v))), 12)
                if s > 0:
                    want.append((-s, floor, m))
        expected = [m for _, _, m in sorted(want)[:7]]
        assert [r.memory_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == query_id] == expected


def test_embedding_sync_keeps_reembeds_and_isolates_failures(spark):
    base = docs(spark).withColumn("character_ids", F.array().cast("array<string>")).withColumn("plotline_ids", F.array().cast("array<string>"))
    refs = spark.createDataFrame([], "chat_id string, branch_id string, memory_id string, content_fingerprint string, binding_fingerprint string, vector array<double>")
    plan = vectors.embedding_plan(base, refs, "s1")

    def encode(texts):
        if any("Bob" in t for t in texts):
            raise RuntimeError("down")
        return vectors.hashing_encoder(4)(texts)

    made = vectors.embed_texts(plan, encode, 2)
    next_refs = vectors.sync_embeddings(refs, plan, made, "s1")
    assert {r.memory_id for r in next_refs.collect()} == {"a", "c", "z"}
    counts = {r.branch_id: (r.indexed, r.failed, r.removed) for r in vectors.sync_counts(plan, made).collect()}
    assert counts == {"b": (2, 1, 0), "other": (1, 0, 0)}
    again = vectors.embedding_plan(base, next_refs, "s1")
    assert {r.memory_id: r.action for r in again.collect()} == {"a": "keep", "c": "keep", "z": "keep", "b": "embed"}
    moved = vectors.embedding_plan(base, next_refs, "s2")
    assert {r.action for r in moved.collect()} == {"embed"}


def test_recall_degrades_to_one_source(spark):
    rows, errors = rc.recall(ask(spark, "ancient gate"), docs(spark))
    assert [r.memory_id for r in rows.collect()] == ["a"]
    assert [r.source for r in errors.collect()] == ["embedding"]
    with pytest.raises(ValueError):
        rc.recall(ask(spark, "x"))


def test_recall_with_a_scorer_and_a_failing_scorer(spark):
    rows = [("c", "b", f"m{i}", i, None, f"gate number {i}", [], False) for i in range(9)]
    memories = spark.createDataFrame(rows, MEMORY)
    options = rc.RecallOptions(rerank_enabled=True, final_recall_count=3, bm25_top_k=9)
    last = lambda query, text: text.str.extract(r"(\d+)")[0].astype(float)
    best, _ = rc.recall(ask(spark, "gate"), memories, reranker=last, options=options)
    assert [r.memory_id for r in best.orderBy("rank").collect()] == ["m8", "m7", "m6"]

    def broken(query, text):
        raise RuntimeError("no model")

    kept, errors = rc.recall(ask(spark, "gate"), memories, reranker=broken, options=options)
    assert [r.memory_id for r in kept.orderBy("rank").collect()] == ["m0", "m1", "m2"]
    assert {r.source for r in errors.collect()} == {"embedding", "rerank"}
