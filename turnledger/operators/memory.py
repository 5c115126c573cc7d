"""Memory batches over a chain: ranges, inputs, reuse, staleness, slices.

``batches``: batch_id, scope, batch_start_floor, batch_end_floor, source_floor_ids,
batch_dependency_fingerprint, stale, created_at, updated_at. Range bounds are 1-based
positions among the synced nodes, not message indexes.
``memories``: memory_id, scope, batch_id, slice_id, start_floor, end_floor, title, summary,
tags, character_ids, plotline_ids, narrative_time, source_floor_ids, stale.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.keys import fingerprint
from turnledger.functions.text import non_blank
from turnledger.operators.bm25 import SCOPE
from turnledger.operators.ranking import latest_per_key
from turnledger.operators.skew import DEFAULT_BLOCK, ordinal, salted_join

DEFAULT_INTERVAL = 30
RANGE = [*SCOPE, "batch_start_floor", "batch_end_floor"]
_STRINGS = "array<string>"


# ---------------------------------------------------------------- ranges


def expected_ranges(
    nodes: DataFrame, interval: int = DEFAULT_INTERVAL, size: int = DEFAULT_BLOCK
) -> DataFrame:
    """Complete groups of ``interval`` synced nodes per scope."""
    interval = interval if isinstance(interval, int) and interval > 0 else DEFAULT_INTERVAL
    synced = nodes.filter("status = 'synced'").select(*SCOPE, "message_index")
    numbered = ordinal(synced, SCOPE, "message_index", "_n", size)
    group = F.floor((F.col("_n") - 1) / interval)
    return (
        numbered.groupBy(*SCOPE, group.alias("_g"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .filter(F.col("_c") == interval)
        .select(
            *SCOPE,
            (F.col("_g") * interval + 1).alias("batch_start_floor"),
            ((F.col("_g") + 1) * interval).alias("batch_end_floor"),
        )
    )


def mismatched_batches(batches: DataFrame, expected: DataFrame) -> DataFrame:
    """Active batches to be marked stale: all of a scope as soon as one has an unexpected range."""
    active = batches.filter("not stale")
    wrong = active.join(expected, RANGE, "left_anti").select(*SCOPE).distinct()
    # A scope that expects nothing yet is left alone.
    planned = wrong.join(expected.select(*SCOPE).distinct(), SCOPE, "left_semi")
    return salted_join(active, planned, SCOPE, [F.col("batch_id")], "left_semi")


def missing_ranges(batches: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected ranges without an active batch."""
    active = batches.filter("not stale").select(*RANGE)
    return expected.select(*RANGE).join(active, RANGE, "left_anti")


# ---------------------------------------------------------------- inputs and dependency


def range_inputs(
    ranges: DataFrame,
    nodes: DataFrame,
    floors: DataFrame,
    deltas: DataFrame,
    size: int = DEFAULT_BLOCK,
) -> DataFrame:
    """What a summary of each range reads; ``reason`` says why a range cannot be built.

    ``floors``: floor_id, chat_id, content, active. ``deltas``: state_node_id, delta (text).
    A range gathers its own floors only, so its arrays are as long as the range.
    """
    synced = nodes.filter("status = 'synced'").select(
        *SCOPE, "message_index", "floor_id", "state_node_id", "state_fingerprint"
    )
    numbered = ordinal(synced, SCOPE, "message_index", "_n", size)
    valid = (F.col("batch_start_floor") >= 1) & (F.col("batch_end_floor") >= F.col("batch_start_floor"))
    wanted = ranges.select(*RANGE).filter(valid).withColumn(
        "_n", F.explode(F.sequence("batch_start_floor", "batch_end_floor"))
    )
    text = floors.filter("active").select("floor_id", "chat_id", "content")
    rows = (
        wanted.join(numbered, [*SCOPE, "_n"])
        .join(text, ["floor_id", "chat_id"], "left")
        .join(deltas.select("state_node_id", "delta"), "state_node_id", "left")
    )
    item = F.struct("_n", "floor_id", "content", "delta", "state_node_id", "state_fingerprint")
    grouped = rows.groupBy(*RANGE).agg(
        F.array_sort(F.collect_list(item)).alias("_rows"),
        F.count("content").alias("_texts"),
    )
    joined = ranges.select(*RANGE).join(grouped, RANGE, "left")
    width = F.col("batch_end_floor") - F.col("batch_start_floor") + 1
    reason = (
        F.when(~valid, "invalid summary range")
        .when(F.coalesce(F.size("_rows"), F.lit(0)) != width, "range requires synchronized floors")
        .when(F.col("_texts") != width, "source floors unavailable")
    )
    last = F.element_at("_rows", -1)
    return joined.select(
        *RANGE,
        reason.alias("reason"),
        F.transform("_rows", lambda r: F.struct(r["floor_id"].alias("floor_id"), r["content"].alias("content"))).alias("floors"),
        F.filter(F.transform("_rows", lambda r: r["delta"]), lambda d: d.isNotNull()).alias("deltas"),
        F.when(F.col("_rows").isNotNull(), last["state_node_id"]).alias("end_state_node_id"),
        F.when(F.col("_rows").isNotNull(), last["state_fingerprint"]).alias("end_state_fingerprint"),
    )


def batch_dependency(prompt: Column) -> Column:
    """Key of everything a summary depends on."""
    sources = F.transform(
        "floors",
        lambda f: F.struct(f["floor_id"].alias("floorId"), fingerprint(f["content"]).alias("contentFingerprint")),
    )
    return fingerprint(
        F.to_json(
            F.struct(
                F.col("branch_id").alias("branchId"),
                F.col("batch_start_floor").alias("batchStartFloor"),
                F.col("batch_end_floor").alias("batchEndFloor"),
                sources.alias("sourceFloors"),
                F.col("deltas").alias("stateDeltas"),
                F.coalesce("end_state_fingerprint", F.lit("")).alias("endStateFingerprint"),
                prompt.alias("prompt"),
            )
        )
    )


def reusable_batches(inputs: DataFrame, batches: DataFrame, memories: DataFrame) -> DataFrame:
    """Inputs with ``batch_id`` of a stored batch of the same dependency, stale or not.

    A batch without slices is never reused, since the search goes through the slices.
    """
    with_slices = memories.select("batch_id").distinct()
    stored = (
        batches.join(with_slices, "batch_id", "left_semi")
        .groupBy(*SCOPE, "batch_dependency_fingerprint")
        .agg(F.min("batch_id").alias("batch_id"))
    )
    return inputs.join(stored, [*SCOPE, "batch_dependency_fingerprint"], "left")


# ---------------------------------------------------------------- staleness


def activate_batches(batches: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen batches become active, other versions of their range stale."""
    pick = chosen.select("batch_id").distinct()
    targets = batches.join(pick, "batch_id", "left_semi").select(
        *RANGE, F.col("batch_id").alias("_active")
    )
    joined = batches.join(targets, RANGE, "left")
    return joined.withColumn(
        "stale",
        F.when(F.col("_active").isNull(), F.col("stale")).otherwise(F.col("batch_id") != F.col("_active")),
    ).drop("_active")


def supersede(batches: DataFrame, inserted: DataFrame) -> DataFrame:
    """Stored and inserted batches; older batches of an inserted range become stale."""
    taken = inserted.select(*RANGE, F.lit(True).alias("_new")).distinct()
    old = batches.join(taken, RANGE, "left").withColumn(
        "stale", F.col("stale") | F.coalesce("_new", F.lit(False))
    )
    return old.drop("_new").unionByName(inserted.select(*batches.columns))


def stale_by_floors(batches: DataFrame, floor_ids: DataFrame) -> DataFrame:
    """Batches that read any of the given floors."""
    pairs = batches.select("batch_id", F.explode("source_floor_ids").alias("floor_id"))
    hit = pairs.join(floor_ids.select("floor_id").distinct(), "floor_id", "left_semi")
    return batches.join(hit.select("batch_id").distinct(), "batch_id", "left_semi")


def mark_stale(batches: DataFrame, memories: DataFrame, stale: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches and memories with the given batches marked stale."""
    ids = stale.select("batch_id").distinct().withColumn("_s", F.lit(True))

    def mark(df: DataFrame) -> DataFrame:
        hit = F.coalesce(F.col("_s"), F.lit(False))
        return df.join(ids, "batch_id", "left").withColumn("stale", F.col("stale") | hit).drop("_s")

    return mark(batches), mark(memories)


def single_survivor(batches: DataFrame) -> DataFrame:
    """Exactly one active batch per range: the newest by update, creation, then id."""
    order = ["updated_at", "created_at", "batch_id"]
    best = latest_per_key(batches.select(*RANGE, *order), RANGE, order)
    marked = batches.join(best.select("batch_id", F.lit(True).alias("_best")), "batch_id", "left")
    return marked.withColumn("stale", F.col("_best").isNull()).drop("_best")


def invalidate_prompt(batches: DataFrame, prompt_version: str) -> DataFrame:
    """Batches summarised under another prompt become stale."""
    return batches.withColumn("stale", F.col("stale") | (F.col("prompt_version") != prompt_version))


def toggle_memories(
    memories: DataFrame, batches: DataFrame, toggles: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(memories after the toggles, rejected toggles) for ``toggles`` (memory_id, stale).

    A memory whose batch is stale cannot be made active again.
    """
    state = batches.select("batch_id", F.col("stale").alias("_batch_stale"))
    wanted = toggles.select("memory_id", F.col("stale").alias("_want"))
    joined = memories.join(wanted, "memory_id", "left").join(state, "batch_id", "left")
    blocked = ~F.col("_want") & F.coalesce("_batch_stale", F.lit(True))
    next_stale = F.when(F.col("_want").isNull() | blocked, F.col("stale")).otherwise(F.col("_want"))
    out = joined.withColumn("_next", next_stale)
    unknown = wanted.join(memories.select("memory_id"), "memory_id", "left_anti").select(
        "memory_id", F.lit("memory does not exist").alias("reason")
    )
    refused = joined.filter(F.col("_want").isNotNull() & blocked).select(
        "memory_id", F.lit("its batch is stale").alias("reason")
    )
    kept = out.withColumn("stale", F.col("_next")).select(*memories.columns)
    return kept, refused.unionByName(unknown)


# ---------------------------------------------------------------- slices


def _texts(item: Column, name: str) -> Column:
    listed = F.coalesce(
        F.try_variant_get(item, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")
    )
    strings = F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING")
    texts = F.transform(strings, lambda x: x.cast("string"))
    return F.array_distinct(F.filter(texts, lambda t: non_blank(t).isNotNull()))


def _text(item: Column, name: str) -> Column:
    value = F.try_variant_get(item, f"$.{name}", "variant")
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, non_blank(value.cast("string")))


def parse_slices(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slices, rejected outputs) from summaries ``(RANGE, batch_id, output)``.

    A slice must lie inside its range with start <= end and a non-blank summary. One bad
    slice rejects the whole output.
    """
    parsed = outputs.withColumn("_v", F.try_parse_json("output")).withColumn(
        "_slices", F.try_variant_get("_v", "$.slices", "array<variant>")
    )
    item = F.col("_item")
    rows = parsed.select(*RANGE, "batch_id", F.posexplode("_slices").alias("_i", "_item")).select(
        *RANGE,
        "batch_id",
        (F.col("_i") + 1).alias("slice_number"),
        F.try_variant_get(item, "$.startFloor", "double").alias("_s"),
        F.try_variant_get(item, "$.endFloor", "double").alias("_e"),
        _text(item, "title").alias("title"),
        _text(item, "summary").alias("summary"),
        _texts(item, "tags").alias("tags"),
        _texts(item, "characterIds").alias("character_ids"),
        _texts(item, "plotlineIds").alias("plotline_ids"),
        _text(item, "narrativeTime").alias("narrative_time"),
    )
    good = (
        (F.col("_s") == F.floor("_s"))
        & (F.col("_e") == F.floor("_e"))
        & (F.col("_s") >= F.col("batch_start_floor"))
        & (F.col("_e") <= F.col("batch_end_floor"))
        & (F.col("_s") <= F.col("_e"))
        & F.col("summary").isNotNull()
    )
    bad = rows.filter(~F.coalesce(good, F.lit(False))).groupBy("batch_id").agg(
        F.min("slice_number").alias("_bad")
    )
    checked = parsed.join(bad, "batch_id", "left")
    reason = (
        F.when(F.col("_v").isNull(), "output is not JSON")
        .when(F.col("_slices").isNull(), "output must contain slices")
        .when(F.col("_bad").isNotNull(), F.concat(F.lit("invalid slice "), F.col("_bad").cast("string")))
    )
    rejected = checked.withColumn("reason", reason).filter("reason is not null").select(
        *RANGE, "batch_id", "reason"
    )
    slices = rows.join(rejected.select("batch_id"), "batch_id", "left_anti")
    return (
        slices.withColumn("start_floor", F.col("_s").cast("long"))
        .withColumn("end_floor", F.col("_e").cast("long"))
        .drop("_s", "_e")
    ), rejected


def slice_sources(ids: Column, batch_start: Column, start: Column, end: Column) -> Column:
    """Floor ids of a slice out of the ids of its batch."""
    return F.slice(ids, (start - batch_start + 1).cast("int"), (end - start + 1).cast("int"))


def memory_rows(slices: DataFrame, batches: DataFrame) -> DataFrame:
    """Memories of new batches: one per slice, with ids and source floors."""
    source = batches.select("batch_id", "source_floor_ids")
    slice_id = F.concat_ws(":", "batch_id", F.lit("slice"), F.col("slice_number").cast("string"))
    return slices.join(source, "batch_id").select(
        F.concat(F.lit("memory:"), slice_id).alias("memory_id"),
        *RANGE,
        "batch_id",
        slice_id.alias("slice_id"),
        "start_floor",
        "end_floor",
        "title",
        "summary",
        "tags",
        "character_ids",
        "plotline_ids",
        "narrative_time",
        slice_sources(
            F.col("source_floor_ids"), F.col("batch_start_floor"), F.col("start_floor"), F.col("end_floor")
        ).alias("source_floor_ids"),
        F.lit(False).alias("stale"),
    )


Summariser = Callable[[list[dict]], list[str]]


def extractive_summariser(inputs: list[dict], words_per_floor: int | None = None) -> list[str]:
    """Deterministic stand-in for a model: one slice with the words of every floor, or the
    first ``words_per_floor`` of each."""
    out = []
    for item in inputs:
        words = [" ".join((f["content"] or "").split()[:words_per_floor]) for f in item["floors"]]
        text = " / ".join(w for w in words if w)
        span = {"startFloor": int(item["batch_start_floor"]), "endFloor": int(item["batch_end_floor"])}
        out.append(json.dumps({"slices": [{**span, "summary": text}] if text else []}))
    return out


def summarise(inputs: DataFrame, summariser: Summariser, attempts: int = 1) -> DataFrame:
    """Run a summariser over batch inputs on the executors; each row keeps its output or error.

    ``inputs`` needs RANGE, batch_id, floors and batch_dependency_fingerprint. The result
    carries the dependency it was made from, so a later check can drop what has changed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outputs, errors = [], []
            for item in batch.to_dict("records"):
                output, error = None, None
                for _ in range(max(1, attempts)):
                    try:
                        output, error = summariser([item])[0], None
                        break
                    except Exception as exc:  # the summariser is user code
                        error = str(exc)
                outputs.append(output)
                errors.append(error)
            yield batch.drop(columns=["floors"]).assign(output=outputs, error=errors)

    columns = [*RANGE, "batch_id", "batch_dependency_fingerprint", "floors"]
    return inputs.select(*columns).mapInPandas(
        run,
        "chat_id string, branch_id string, batch_start_floor bigint, batch_end_floor bigint, "
        "batch_id string, batch_dependency_fingerprint string, output string, error string",
    )


def still_current(summaries: DataFrame, inputs: DataFrame) -> DataFrame:
    """Summaries whose sources and prompt have not changed since they were started."""
    now = inputs.select(*RANGE, "batch_dependency_fingerprint")
    return summaries.join(now, [*RANGE, "batch_dependency_fingerprint"], "left_semi")


# ---------------------------------------------------------------- scans


def attach_children(
    memories: DataFrame, tags: DataFrame, characters: DataFrame, plotlines: DataFrame
) -> DataFrame:
    """Memory rows with their child tables as sorted array columns."""

    def lists(child: DataFrame, column: str, out: str) -> DataFrame:
        return child.groupBy("memory_id").agg(F.sort_array(F.collect_list(column)).alias(out))

    out = memories
    for child, column, name in (
        (tags, "tag", "tags"),
        (characters, "character_id", "character_ids"),
        (plotlines, "plotline_id", "plotline_ids"),
    ):
        out = out.join(lists(child, column, name), "memory_id", "left").withColumn(
            name, F.coalesce(name, F.array().cast(_STRINGS))
        )
    return out


def list_memories(
    memories: DataFrame, chat_id: str, branch_id: str | None = None, include_stale: bool = False
) -> DataFrame:
    """Memories of a chat in floor order, active ones only unless asked otherwise."""
    out = memories.filter(F.col("chat_id") == chat_id)
    if branch_id is not None:
        out = out.filter(F.col("branch_id") == branch_id)
    if not include_stale:
        out = out.filter("not stale")
    return out.orderBy("start_floor", "slice_id")


def list_scopes(batches: DataFrame) -> DataFrame:
    return batches.select(*SCOPE).distinct().orderBy(*SCOPE)


def child_rows(memories: DataFrame, column: str, out: str) -> DataFrame:
    """Array column as child rows ``(memory_id, value)``."""
    return memories.select("memory_id", F.explode(column).alias(out))
