"""Token-budgeted packing of memories and the recent-message window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.text import (
    cjk_count,
    estimate_tokens,
    regex_summary,
    tokens_from_counts,
    trim_ws,
)
from turnledger.operators.bm25 import SCOPE
from turnledger.operators.ranking import top_k
from turnledger.operators.skew import DEFAULT_BLOCK, last_before, ordinal

QUERY = [*SCOPE, "query_id"]


@dataclass(frozen=True)
class PackOptions:
    """Defaults are fixed values of the packing rules."""

    max_count: int = 6
    fixed_count: int = 2
    token_limit: int | None = None
    token_ratio: float = 0.03
    min_budget: int = 2000
    max_budget: int = 6000
    # Texts placed around the packed memories. They take part in the budget.
    header: str = (
        "[长期记忆]\n\n以下是较早发生过的剧情记忆，只读参考。\n与最近正文冲突时，以最近正文为准。\n\n"
    )
    item_label: str = "记忆"


def token_budget(context_window: Column, options: PackOptions = PackOptions()) -> Column:
    """max(min, min(window x ratio, max)), or the explicit limit."""
    if options.token_limit is not None and options.token_limit >= 0:
        return F.lit(float(options.token_limit))
    window = F.coalesce(F.greatest(context_window.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(
        F.lit(float(options.min_budget)),
        F.least(window * F.lit(options.token_ratio), F.lit(float(options.max_budget))),
    )


def fixed_recent(memories: DataFrame, n: int = 2) -> DataFrame:
    """The n most recent active memories of each scope."""
    order = [F.desc("end_floor"), F.desc("start_floor"), F.asc("memory_id")]
    if n <= 0:
        return memories.filter("false").withColumn("rank", F.lit(0))
    return top_k(memories.filter(~F.col("stale")), SCOPE, order, n)


COUNTS = ["fixed_recent_candidate_count", "recall_candidate_count"]


def merge_candidates(fixed: DataFrame, recalled: DataFrame, counts: bool = False) -> DataFrame:
    """Fixed-recent rows first, then recall order; the first occurrence of an id wins.

    Both sides have scope, query_id, memory_id and rank. Adds ``source`` and the
    1-based candidate position ``ord``. ``counts`` adds how many rows each side has for the
    query, so that nobody has to make the two lists again to count them.
    """
    keys = [*QUERY, "memory_id"]
    first = fixed.select(*keys, F.lit(0).alias("_p"), F.col("rank").cast("int").alias("_r"))
    second = recalled.select(*keys, F.lit(1).alias("_p"), F.col("rank").cast("int").alias("_r"))
    chosen = (
        first.unionByName(second)
        .groupBy(*keys)
        .agg(
            F.min(F.struct("_p", "_r")).alias("_best"),
            *[F.count_if(F.col("_p") == p).alias(name) for p, name in enumerate(COUNTS) if counts],
        )
    )
    order, whole = Window.partitionBy(*QUERY).orderBy("_best"), Window.partitionBy(*QUERY)
    return chosen.select(
        *keys,
        F.when(F.col("_best._p") == 0, "fixed_recent").otherwise("high_relevance").alias("source"),
        F.row_number().over(order).alias("ord"),
        *[F.sum(name).over(whole).alias(name) for name in COUNTS if counts],
    )


def memory_block(options: PackOptions = PackOptions()) -> Column:
    """Rendered text of one memory."""
    title = trim_ws(F.coalesce(F.col("title"), F.lit("")))
    return F.concat(
        F.lit(f"[{options.item_label} "),
        F.col("start_floor").cast("string"),
        F.lit("-"),
        F.col("end_floor").cast("string"),
        F.lit("]\n"),
        F.when(title != "", F.concat(title, F.lit("\n"))).otherwise(F.lit("")),
        trim_ws(F.col("summary")),
    )


def pack(candidates: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """Greedy packing per query: an item that would overflow is skipped, not a stop.

    ``candidates``: scope, query_id, ord, source, memory_id, start_floor, end_floor,
    title, summary, budget, and perhaps the counts of both sides. The list of one query is short by construction (the recall
    result plus the fixed-recent rows), so it is folded as one array. The rendered size
    is additive: tokens = CJK characters + ceil(other / 4) over header, items, separators.
    """
    header_cjk, header_len = cjk_count(F.lit(options.header)), len(options.header)
    block = memory_block(options)
    sized = candidates.withColumn("_text", block).withColumn("_cjk", cjk_count(F.col("_text")))
    item = F.struct(
        F.col("ord"),
        "memory_id",
        "source",
        "start_floor",
        "end_floor",
        F.col("_text").alias("text"),
        F.col("_cjk").alias("cjk"),
        (F.length("_text") - F.col("_cjk")).alias("other"),
    )
    counts = [name for name in COUNTS if name in candidates.columns]
    grouped = sized.groupBy(*QUERY).agg(
        F.array_sort(F.collect_list(item)).alias("_items"),
        F.max("budget").alias("token_limit"),
        *[F.max(name).alias(name) for name in counts],
    )
    start = F.struct(
        F.lit(0).alias("n"),
        header_cjk.cast("int").alias("cjk"),
        (F.lit(header_len) - header_cjk).cast("int").alias("other"),
        F.array().cast("array<int>").alias("taken"),
        F.lit(0).alias("over_budget"),
        F.lit(0).alias("over_count"),
    )

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(acc["n"] > 0, F.lit(2)).otherwise(F.lit(0))
        cjk = (acc["cjk"] + x["cjk"]).cast("int")
        other = (acc["other"] + x["other"] + gap).cast("int")
        full = acc["n"] >= options.max_count
        fits = tokens_from_counts(cjk, other) <= F.col("token_limit")
        take = ~full & fits

        def pick(new: Column, old: Column) -> Column:
            return F.when(take, new).otherwise(old)

        return F.struct(
            pick(acc["n"] + 1, acc["n"]).alias("n"),
            pick(cjk, acc["cjk"]).alias("cjk"),
            pick(other, acc["other"]).alias("other"),
            pick(F.array_append(acc["taken"], x["ord"]), acc["taken"]).alias("taken"),
            F.when(~full & ~fits, acc["over_budget"] + 1)
            .otherwise(acc["over_budget"])
            .alias("over_budget"),
            F.when(full, acc["over_count"] + 1).otherwise(acc["over_count"]).alias("over_count"),
        )

    folded = grouped.withColumn("_fold", F.aggregate("_items", start, step))
    packed = F.filter("_items", lambda x: F.array_contains(F.col("_fold.taken"), x["ord"]))
    shown = F.transform(
        F.array_sort(
            F.transform(
                packed,
                lambda x: F.struct(
                    x["start_floor"].alias("s"),
                    x["end_floor"].alias("e"),
                    x["memory_id"].alias("m"),
                    x["text"].alias("t"),
                ),
            )
        ),
        lambda x: x["t"],
    )
    text = F.when(
        F.col("_fold.n") > 0, F.concat(F.lit(options.header), F.array_join(shown, "\n\n"))
    ).otherwise(F.lit(""))
    fixed = F.size(F.filter(packed, lambda x: x["source"] == "fixed_recent"))
    tokens = F.when(
        F.col("_fold.n") > 0, tokens_from_counts(F.col("_fold.cjk"), F.col("_fold.other"))
    ).otherwise(F.lit(0))
    return folded.select(
        *QUERY,
        F.transform(packed, lambda x: x["memory_id"]).alias("memory_ids"),
        text.alias("text"),
        "token_limit",
        tokens.alias("estimated_tokens"),
        F.size("_items").alias("deduplicated_count"),
        F.col("_fold.n").alias("packed_count"),
        fixed.alias("packed_fixed_recent_count"),
        (F.col("_fold.n") - fixed).alias("packed_high_relevance_count"),
        F.col("_fold.over_budget").alias("skipped_by_token_budget"),
        F.col("_fold.over_count").alias("skipped_by_count"),
        *counts,
    )


def pack_diagnostics(packed: DataFrame, fixed: DataFrame, recalled: DataFrame) -> DataFrame:
    """Counters of a packing run, with the candidate counts of both inputs. Where the packed rows
    bring them, the inputs are not read."""
    if set(COUNTS) <= set(packed.columns):
        return packed.drop("text", "memory_ids")
    fixed_n = fixed.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("fixed_recent_candidate_count"))
    recall_n = recalled.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("recall_candidate_count"))
    return (
        packed.drop("text", "memory_ids")
        .join(fixed_n, QUERY, "left")
        .join(recall_n, QUERY, "left")
        .fillna(0, ["fixed_recent_candidate_count", "recall_candidate_count"])
    )


def recent_window(
    requests: DataFrame, floors: DataFrame, n: int = 4, size: int = DEFAULT_BLOCK
) -> DataFrame:
    """The last n floors before each request, with ``slot`` 1 for the newest.

    ``requests``: scope, query_id, user_index (null means after everything). Requests and
    floors are never paired across a chat: each request finds the ordinal of the floor
    before it, then joins its n ordinals by equality.
    """
    n = max(1, n)
    numbered = ordinal(floors, SCOPE, "message_index", size=size)
    points = requests.select(*SCOPE, "query_id", "user_index")
    found = last_before(
        points, numbered, SCOPE, "user_index", "message_index", {"_last": "ordinal"}, size
    )
    slots = (
        found.filter("_last is not null")
        .select(*SCOPE, "query_id", "_last", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("slot"))
        .withColumn("ordinal", F.col("_last") - F.col("slot") + 1)
        .filter(F.col("ordinal") >= 1)
        .drop("_last")
    )
    return slots.join(numbered, [*SCOPE, "ordinal"]).drop("ordinal")


def recent_context(window: DataFrame, mode: str = "raw", pattern: str = "") -> DataFrame:
    """Text of each recent floor and its source: raw, summary or fallback."""
    if mode != "summary":
        return window.withColumn("text", F.col("content")).withColumn("source", F.lit("raw"))
    found = regex_summary(F.col("content"), pattern)
    return (
        window.withColumn("_found", found)
        .withColumn("text", F.coalesce("_found", "content"))
        .withColumn("source", F.when(F.col("_found").isNull(), "fallback").otherwise("summary"))
        .drop("_found")
    )


def recall_query(requests: DataFrame, recent: DataFrame) -> DataFrame:
    """Query text per request: the user text, then the recent texts oldest first.

    A request has the rows of its window only, so they are gathered as one array.
    """
    texts = recent.groupBy(*QUERY).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("slot")).alias("o"), "text"))),
            lambda x: x["text"],
        ).alias("_texts")
    )
    joined = requests.select(*QUERY, "user_text").join(texts, QUERY, "left")
    parts = F.concat(
        F.array("user_text"), F.coalesce("_texts", F.array().cast("array<string>"))
    )
    return joined.select(
        *QUERY, F.array_join(F.filter(parts, lambda t: trim_ws(t) != ""), "\n").alias("text")
    )

