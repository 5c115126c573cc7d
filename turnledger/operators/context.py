"""Which parts of a state matter for a request, and how they are written out.

All tables are keyed by the request (scope and query_id), whose snapshot they belong to, so
every join is per request and no chat can dominate one.

``profiles``: character_id, canonical_name, aliases. ``now_items``: id, related_character_ids,
related_plotline_ids. ``plotlines``: id, stage, stalled, pinned, related_character_ids.
``plans``: id, status, pinned, related_character_ids, related_plotline_ids.
``calendar``: id, date_key, confirmed, related_character_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.keys import split_pointer
from turnledger.functions.parse import path_exists
from turnledger.functions.text import estimate_tokens, non_blank
from turnledger.operators.pack import QUERY

# Field lists, the closing stage of a plotline, open plan statuses, labels.
PROFILE_FIELDS = ["canonicalName", "basic", "identity", "personality", "appearance", "lifeDetails"]
TRACE_FIELDS = ["longTermTendencies", "currentSituations", "visibility", "affinity"]
STORY_FIELDS = ["now", "calendar", "plotlines", "plotPlans"]
TRACE_LISTS = ["longTermTendencies", "currentSituations", "visibility"]
STORY_LISTS = ["calendar", "plotlines", "plotPlans"]
FADING_STAGE = "淡出"
OPEN_PLANS = ["planned", "triggered"]
INTRO = "[当前状态]\n\n以下是当前剧情的结构化状态，只读参考。若与最新正文冲突，以最新正文为准。"
SECTIONS = {
    "profiles": ("[谱]", "暂无与当前输入或近期剧情相关的人物。"),
    "traces": ("[迹]", "暂无相关人物当前状态。"),
    "now": ("[事·现在]", "{}"),
    "recent": ("[近期上下文]", "暂无近期正文。"),
    "calendar": ("[事·日历]", "当前日期附近暂无已确认事项。"),
    "plotlines": ("[事·剧情线]", "暂无当前相关剧情线。"),
    "plans": ("[事·剧情安排]\n以下为未来规划，不代表已经发生。", "暂无当前相关剧情安排。"),
}
RECENT_LABELS = {"summary": "摘要", "fallback": "摘要失败，使用原文", "raw": "原文"}


# ---------------------------------------------------------------- selection


def request_corpus(requests: DataFrame, recent: DataFrame) -> DataFrame:
    """Lower-cased user text and recent texts; at most twenty recent rows per request."""
    texts = recent.groupBy(*QUERY).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("slot")).alias("o"), "text"))),
                lambda x: x["text"],
            ),
            "\n",
        ).alias("_t")
    )
    joined = requests.select(*QUERY, "user_text").join(texts, QUERY, "left")
    return joined.select(
        *QUERY,
        F.lower(F.concat(F.col("user_text"), F.lit("\n"), F.coalesce("_t", F.lit("")))).alias("corpus"),
    )


def is_active_plotline() -> Column:
    pinned = F.coalesce("pinned", F.lit(False))
    stalled = F.coalesce("stalled", F.lit(False))
    return pinned | (~stalled & (F.col("stage") != FADING_STAGE))


def related_characters(
    corpus: DataFrame, profiles: DataFrame, now_items: DataFrame, plotlines: DataFrame
) -> DataFrame:
    """Characters named in the corpus, taking part now, or in an active plotline; profiles only."""
    names = F.concat(F.array("character_id", "canonical_name"), F.col("aliases"))
    named = (
        profiles.select(*QUERY, "character_id", names.alias("_names"))
        .join(corpus, QUERY)
        .filter(
            F.exists(
                "_names",
                lambda n: F.coalesce((n != "") & F.contains(F.col("corpus"), F.lower(n)), F.lit(False)),
            )
        )
        .select(*QUERY, "character_id")
    )
    listed = now_items.select(*QUERY, F.explode("related_character_ids").alias("character_id")).unionByName(
        plotlines.filter(is_active_plotline()).select(
            *QUERY, F.explode("related_character_ids").alias("character_id")
        )
    )
    known = profiles.select(*QUERY, "character_id")
    return named.unionByName(listed.join(known, [*QUERY, "character_id"], "left_semi")).distinct()


def related_plotlines(profiles: DataFrame, now_items: DataFrame, plotlines: DataFrame) -> DataFrame:
    """Plotlines linked from the present scene, and active ones with a known character."""
    ids = plotlines.select(*QUERY, F.col("id").alias("plotline_id"))
    scene = now_items.select(*QUERY, F.explode("related_plotline_ids").alias("plotline_id")).join(
        ids, [*QUERY, "plotline_id"], "left_semi"
    )
    known = profiles.select(*QUERY, "character_id")
    active = (
        plotlines.filter(is_active_plotline())
        .select(*QUERY, F.col("id").alias("plotline_id"), F.explode("related_character_ids").alias("character_id"))
        .join(known, [*QUERY, "character_id"], "left_semi")
        .select(*QUERY, "plotline_id")
    )
    return scene.unionByName(active).distinct()


def selected_plans(plans: DataFrame, characters: DataFrame, lines: DataFrame) -> DataFrame:
    """Open plans that are pinned or touch a related character or plotline."""
    open_plans = plans.filter(F.col("status").isin(OPEN_PLANS))
    by_character = (
        open_plans.select(*QUERY, "id", F.explode("related_character_ids").alias("character_id"))
        .join(characters, [*QUERY, "character_id"], "left_semi")
        .select(*QUERY, "id")
    )
    by_line = (
        open_plans.select(*QUERY, "id", F.explode("related_plotline_ids").alias("plotline_id"))
        .join(lines, [*QUERY, "plotline_id"], "left_semi")
        .select(*QUERY, "id")
    )
    pinned = open_plans.filter(F.coalesce("pinned", F.lit(False))).select(*QUERY, "id")
    chosen = pinned.unionByName(by_character).unionByName(by_line).distinct()
    return open_plans.join(chosen, [*QUERY, "id"], "left_semi")


def _date(text: Column) -> Column:
    return F.try_to_date(F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")


def selected_calendar(calendar: DataFrame, times: DataFrame, characters: DataFrame) -> DataFrame:
    """Confirmed entries within a day of the current time, or of a related character.

    ``times``: one current_time per request. Without a readable date every confirmed entry
    counts. The band is a join on three candidate days, not a comparison of all dates.
    """
    confirmed = calendar.filter("confirmed")
    now = times.select(*QUERY, _date(F.col("current_time")).alias("_today"))
    dated = now.filter("_today is not null")
    days = dated.select(*QUERY, F.explode(F.sequence(F.date_sub("_today", 1), F.date_add("_today", 1))).alias("_day"))
    near = (
        confirmed.withColumn("_day", _date(F.col("date_key")))
        .join(days, [*QUERY, "_day"], "left_semi")
        .select(*QUERY, "id")
    )
    undated = confirmed.join(dated.select(*QUERY), QUERY, "left_anti").select(*QUERY, "id")
    related = (
        confirmed.select(*QUERY, "id", F.explode("related_character_ids").alias("character_id"))
        .join(characters, [*QUERY, "character_id"], "left_semi")
        .select(*QUERY, "id")
    )
    chosen = near.unionByName(undated).unionByName(related).distinct()
    return confirmed.join(chosen, [*QUERY, "id"], "left_semi").dropDuplicates([*QUERY, "id"])


# ---------------------------------------------------------------- external state


def resolve_mappings(mappings: DataFrame, documents: DataFrame) -> DataFrame:
    """Outcome per mapping: equivalent, related, or a failure reason, with the slot it covers.

    ``mappings``: request key, mapping_id, external_path, domain, path, field, character_id,
    item_id, semantic_key, mode, enabled. ``documents``: request key, document (JSON text). Both grow
    with the requests, so they are merged: neither is gathered on the driver.
    """
    present = documents.filter("document is not null").select(*QUERY, "document")
    joined = mappings.join(present.hint("merge"), QUERY)
    given = F.coalesce(F.nullif("path", F.lit("")), F.nullif("field", F.lit("")))
    parts = F.filter(F.split(F.coalesce(given, F.lit("")), r"\."), lambda p: p != "")
    head, size = F.get(parts, 0), F.size(parts)
    whole = F.array_join(parts, ".")
    rest = F.when(size > 1, F.array_join(F.slice(parts, 2, F.greatest(size - 1, F.lit(0))), "."))
    item = F.coalesce("item_id", "semantic_key", rest)
    has_character = F.col("character_id").isNotNull()
    text = F.lit(None).cast("string")

    def slot(character: Column, field: Column, item_id: Column, key: Column) -> Column:
        return F.struct(
            F.col("domain").alias("domain"),
            character.alias("character_id"),
            field.alias("field"),
            item_id.alias("item_id"),
            key.alias("semantic_key"),
        )

    key = F.coalesce("semantic_key", F.when(F.col("item_id").isNull(), rest))
    in_profile = (F.col("domain") == "profile") & head.isin(PROFILE_FIELDS) & has_character
    in_trace = (F.col("domain") == "trace") & head.isin(TRACE_FIELDS) & has_character
    in_story = (F.col("domain") == "story") & head.isin(STORY_FIELDS)
    found = (
        F.when(in_profile, slot(F.col("character_id"), whole, text, text))
        .when(in_trace & (head == "affinity") & (size > 1), slot(F.col("character_id"), whole, text, text))
        .when(in_trace & ~(head.isin(TRACE_LISTS) & item.isNull()), slot(F.col("character_id"), head, F.col("item_id"), key))
        .when(in_story & (head == "now") & (size > 1), slot(text, whole, text, text))
        .when(in_story & ~(head.isin(STORY_LISTS) & item.isNull()), slot(text, head, F.col("item_id"), key))
    )
    usable = F.col("enabled") & (F.coalesce("external_path", F.lit("")) != "") & given.isNotNull()
    outcome = (
        F.when(~usable, "target is missing")
        .when(~path_exists(F.col("document"), F.col("external_path")), "external path not found")
        .when(F.col("_slot").isNull(), "unsupported target")
        .when(F.col("mode").isin("related", "equivalent"), F.col("mode"))
        .otherwise("unsupported mode")
    )
    return joined.withColumn("_slot", found).select(
        *QUERY, "mapping_id", outcome.alias("outcome"), F.col("_slot").alias("slot")
    )


def suppressions(resolved: DataFrame) -> DataFrame:
    """Distinct slots that external state replaces."""
    return resolved.filter("outcome = 'equivalent'").select(*QUERY, "slot.*").distinct()


def _slots(suppressed: DataFrame) -> DataFrame:
    return suppressed.select(
        *QUERY,
        "domain",
        F.col("character_id").alias("_who"),
        "field",
        F.col("item_id").alias("_item"),
        F.col("semantic_key").alias("_key"),
    )


def visible_fields(fields: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Fields ``(request, domain, character_id, field, sub_field, ...)`` that are not replaced.

    A slot covers a field when domain and field agree, its character is the same or not
    given, and it names no single item.
    """
    whole = _slots(suppressed).filter("_item is null and _key is null").select(*QUERY, "domain", "_who", "field")
    anyone = F.coalesce("_who", F.lit("*")).alias("_m")
    covers = whole.select(*QUERY, "domain", anyone, F.col("field").alias("_f"))
    names = F.array(F.col("field"), F.concat_ws(".", "field", "sub_field"))
    who = F.array(F.lit("*"), F.coalesce("character_id", F.lit("*")))
    probes = (
        fields.withColumn("_n", names)
        .withColumn("_f", F.explode(F.array_distinct("_n")))
        .withColumn("_m", F.explode(F.array_distinct(who)))
    )
    row = [*QUERY, "domain", "character_id", "field", "sub_field"]
    hit = probes.join(covers, [*QUERY, "domain", "_f", "_m"], "left_semi").select(*row).distinct()
    return _anti_null_safe(fields, hit, row)


def _anti_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    l, r = left.alias("l"), right.alias("r")
    condition = None
    for k in keys:
        same = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        condition = same if condition is None else condition & same
    return l.join(r, condition, "left_anti")


def visible_items(items: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Items ``(request, domain, character_id, field, id, text, ...)`` that are not replaced.

    A slot covers an item by the whole field, by its id, or by a key that is its id or
    part of its text.
    """
    i, s = items.alias("i"), _slots(suppressed).alias("s")
    same = (
        (F.col("i.chat_id") == F.col("s.chat_id"))
        & (F.col("i.branch_id") == F.col("s.branch_id"))
        & (F.col("i.query_id") == F.col("s.query_id"))
        & (F.col("i.domain") == F.col("s.domain"))
        & (F.col("i.field") == F.col("s.field"))
    )
    character = F.col("s._who").isNull() | F.col("s._who").eqNullSafe(F.col("i.character_id"))
    covered = (
        (F.col("s._item").isNull() & F.col("s._key").isNull())
        | F.col("s._item").eqNullSafe(F.col("i.id"))
        | F.col("s._key").eqNullSafe(F.col("i.id"))
        | F.coalesce(
            (F.col("s._key") != "") & F.contains(F.col("i.text"), F.col("s._key")), F.lit(False)
        )
    )
    return i.join(s, same & character & covered, "left_anti")


# ---------------------------------------------------------------- rendering


def entity_json(fields: DataFrame, keys: list[str], id_field: str | None = None) -> DataFrame:
    """One JSON line per entity from its field rows ``(keys, field, sub_field, value)``.

    Fields keep the order of ``ord``; members of a group are sorted by name.
    """
    quoted = F.regexp_replace(F.to_json(F.array("sub_field")), r"^\[|\]$", "")
    member = F.when(F.col("sub_field").isNotNull(), F.concat(quoted, F.lit(":"), F.col("value")))
    groups = fields.groupBy(*keys, "ord", "field").agg(
        F.array_join(F.array_sort(F.collect_list(member)), ",").alias("_members"),
        F.max(F.when(F.col("sub_field").isNull(), F.col("value"))).alias("_whole"),
    )
    body = F.coalesce("_whole", F.concat(F.lit("{"), F.col("_members"), F.lit("}")))
    entry = F.struct("ord", F.concat(F.lit('"'), "field", F.lit('":'), body).alias("t"))
    lines = groups.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), ",").alias("_b")
    )
    return lines.select(*keys, F.concat(F.lit("- {"), F.col("_b"), F.lit("}")).alias("line"))


def profile_fields(rows: DataFrame, characters: DataFrame) -> DataFrame:
    """Field rows of the chosen profiles out of state rows ``(request, path, value)``."""
    parts = split_pointer(F.col("path"))
    split = rows.filter("value is not null").select(
        *QUERY,
        F.get(parts, 0).alias("_section"),
        F.get(parts, 1).alias("character_id"),
        F.get(parts, 2).alias("field"),
        F.get(parts, 3).alias("sub_field"),
        "value",
    )
    order = F.array_position(F.array(*[F.lit(f) for f in PROFILE_FIELDS]), F.col("field"))
    return (
        split.filter((F.col("_section") == "profiles") & F.col("field").isin(PROFILE_FIELDS))
        .join(characters, [*QUERY, "character_id"], "left_semi")
        .select(*QUERY, F.lit("profile").alias("domain"), "character_id", "field", "sub_field", "value", order.alias("ord"))
    )


def render_state(requests: DataFrame, lines: dict[str, DataFrame]) -> DataFrame:
    """Text of the current state per request.

    ``lines`` maps a section to its rows ``(request, ord, line)``; a section without rows
    shows its empty text. One request's own lines are joined into one text.
    """
    out = requests.select(*QUERY)
    parts = [F.lit(INTRO)]
    for name, (title, empty) in SECTIONS.items():
        rows = lines.get(name)
        if rows is None:
            body = F.lit(empty)
        else:
            joined = rows.groupBy(*QUERY).agg(
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n"
                ).alias(f"_{name}")
            )
            out = out.join(joined, QUERY, "left")
            body = F.coalesce(F.col(f"_{name}"), F.lit(empty))
        parts.append(F.concat(F.lit(title + "\n"), body))
    text = F.concat_ws("\n\n", *parts)
    return out.select(*QUERY, text.alias("text")).withColumn("tokens", estimate_tokens(F.col("text")))


def recent_lines(recent: DataFrame) -> DataFrame:
    """Recent floors as lines, oldest first."""
    labels = F.create_map(*[F.lit(x) for kv in RECENT_LABELS.items() for x in kv])
    line = F.concat(
        F.lit("- AI楼 "), F.col("message_index").cast("string"), F.lit("（"),
        F.element_at(labels, F.col("source")), F.lit("）："), F.col("text"),
    )
    return recent.select(*QUERY, F.col("message_index").alias("ord"), line.alias("line"))


def readable(text: Column) -> Column:
    return non_blank(text)
