"""A context per request: readiness, current state text, packed memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.operators import pack as pk
from turnledger.operators.bm25 import SCOPE
from turnledger.operators.chain import floor_results
from turnledger.operators.skew import DEFAULT_BLOCK, last_before

QUERY = [*SCOPE, "query_id"]


def readiness(
    requests: DataFrame, prefix: DataFrame, results: DataFrame, size: int = DEFAULT_BLOCK
) -> DataFrame:
    """Whether the state before each request is usable, and why not.

    ``ready`` when nothing precedes the request or the floor before it is valid. Otherwise
    the reason tells work in flight from work that has to be started.
    """
    found = last_before(
        requests.select(*QUERY, "user_index"),
        prefix,
        SCOPE,
        "user_index",
        "message_index",
        {"floor_id": "floor_id", "_valid": "valid", "state_node_id": "state_node_id"},
        size,
    )
    flying = floor_results(results).select("floor_id", "in_flight")
    joined = found.join(flying, "floor_id", "left")
    reason = F.when(F.col("floor_id").isNull() | F.col("_valid"), F.lit(None)).otherwise(
        F.when(F.coalesce("in_flight", F.lit(False)), "state_sync_pending").otherwise("state_sync_failed")
    )
    return joined.withColumn("reason", reason).select(
        *QUERY, F.col("reason").isNull().alias("ready"), "reason", "state_node_id"
    )


def pack_for_requests(
    requests: DataFrame,
    recalled: DataFrame,
    memories: DataFrame,
    options: pk.PackOptions = pk.PackOptions(),
) -> DataFrame:
    """Fixed-recent and recalled memories of each request, packed under its token budget.

    ``requests`` carries context_size.
    """
    newest = pk.fixed_recent(memories, min(options.fixed_count, options.max_count)).select(
        *SCOPE, "memory_id", "rank"
    )
    fixed = requests.select(*QUERY).join(newest, SCOPE)
    candidates = pk.merge_candidates(fixed, recalled)
    detail = memories.select(*SCOPE, "memory_id", "start_floor", "end_floor", "title", "summary")
    budget = requests.select(*QUERY, pk.token_budget(F.col("context_size"), options).alias("budget"))
    rows = candidates.join(detail, [*SCOPE, "memory_id"]).join(budget, QUERY)
    return pk.pack(rows, options)


def prepare_context(
    requests: DataFrame,
    prefix: DataFrame,
    results: DataFrame,
    state_texts: DataFrame,
    recalled: DataFrame,
    memories: DataFrame,
    options: pk.PackOptions = pk.PackOptions(),
    size: int = DEFAULT_BLOCK,
) -> DataFrame:
    """One row per request: ready, reason, long_memory, current_state, token counts.

    ``state_texts`` (request key, text, tokens) comes from ``context.render_state``. A
    request that is not ready gets neither text. The gate is joined last, so the chain is
    walked once.
    """
    gate = readiness(requests, prefix, results, size)
    packed = pack_for_requests(requests, recalled, memories, options)
    memory = packed.select(
        *QUERY,
        F.col("text").alias("_memory"),
        "packed_count",
        F.col("estimated_tokens").alias("memory_tokens"),
    )
    state = state_texts.select(*QUERY, F.col("text").alias("_state"), F.col("tokens").alias("_tokens"))
    joined = gate.join(memory, QUERY, "left").join(state, QUERY, "left")
    ready = F.col("ready")
    return joined.select(
        *QUERY,
        "ready",
        "reason",
        "state_node_id",
        F.coalesce(F.when(ready, F.col("_memory")), F.lit("")).alias("long_memory"),
        F.coalesce(F.when(ready, F.col("_state")), F.lit("")).alias("current_state"),
        F.coalesce(F.when(ready, F.col("packed_count")), F.lit(0)).alias("memory_count"),
        F.coalesce(F.when(ready, F.col("memory_tokens")), F.lit(0)).alias("memory_tokens"),
        F.coalesce(F.when(ready, F.col("_tokens")), F.lit(0)).alias("state_tokens"),
    )
