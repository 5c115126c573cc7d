"""Manual edits of the current state: set, clear, lock, unlock, restore.

``edits``: scope, edit_seq, target (profile, trace, story), entity_id, field_path (dotted),
value (JSON text, ``""`` clears), action (lock, unlock, restore-ai or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.keys import ancestors, escape_segment
from turnledger.functions.rules import PROFILE_PATHS
from turnledger.operators.bm25 import SCOPE
from turnledger.operators.state_log import flatten_documents

ACTIONS = ["lock", "unlock", "restore-ai"]
# Members that only the program writes.
RESERVED = ["source", "characterId", "updatedAt", "sourcePriority", "lockedPaths"]


def check_overrides(edits: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits that may be applied, rejected edits with a reason).

    ``heads``: the scopes that have a valid state node to edit.
    """
    known = heads.select(*SCOPE, F.lit(True).alias("_head")).distinct()
    joined = edits.join(known, SCOPE, "left")
    path = F.coalesce("field_path", F.lit(""))
    segments = F.split(path, r"\.")
    reserved = F.exists(segments, lambda s: (s == "") | s.isin(RESERVED))
    has_action = F.col("action").isNotNull()
    reason = (
        F.when(F.col("_head").isNull(), "the branch has no valid state node")
        .when(~F.coalesce(F.col("target").isin("profile", "trace", "story"), F.lit(False)), "invalid target")
        .when(has_action & ~F.col("action").isin(ACTIONS), "invalid action")
        .when(has_action & (F.col("target") != "profile"), "locks apply to profile fields")
        .when((path != "") & (F.col("target") == "profile") & ~path.isin(PROFILE_PATHS), "unknown profile field")
        .when(has_action & (path == ""), "field path is required")
        .when((path != "") & reserved, "invalid field path")
        .when((F.col("target") != "story") & (F.coalesce("entity_id", F.lit("")) == ""), "entity id is required")
        .when(F.size(segments) > 2, "unsupported field path")
    )
    marked = joined.withColumn("reason", reason).drop("_head")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def _entity() -> Column:
    section = F.when(F.col("target") == "profile", "/profiles/").otherwise("/traces/")
    return F.when(F.col("target") == "story", F.lit("/story")).otherwise(
        F.concat(section, escape_segment(F.col("entity_id")))
    )


def _json_text(value: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def override_events(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """What the edits do to the state, as log rows: the last edit of a path wins.

    ``rows``: the current state rows (scope, path, kind, value). Setting a profile field
    marks it as manual, restoring it drops the mark and the lock. An unknown profile gets
    its name. Locks of one profile are the stored ones with the last action per field.
    """
    dotted = F.col("field_path")
    pointer = F.concat(_entity(), F.lit("/"), F.replace(dotted, F.lit("."), F.lit("/")))
    mark = F.concat(_entity(), F.lit("/sourcePriority/"), dotted)

    def event(path: Column, op: Column, value: Column) -> Column:
        return F.struct(path.alias("path"), op.alias("op"), value.alias("value"))

    none = F.lit(None).cast("string")
    writes = F.col("action").isNull() & dotted.isNotNull() & F.col("value").isNotNull()
    clears = F.col("value") == '""'
    set_field = event(
        pointer,
        F.when(clears, "remove").otherwise("replace"),
        F.when(~clears, F.col("value")),
    )
    is_profile = F.col("target") == "profile"
    set_mark = F.when(writes & is_profile, event(mark, F.lit("replace"), F.lit('"manual"'))).when(
        F.col("action") == "restore-ai", event(mark, F.lit("remove"), none)
    )
    produced = F.filter(F.array(F.when(writes, set_field), set_mark), lambda e: e.isNotNull())
    fields = edits.select(*SCOPE, "edit_seq", F.inline(produced))

    stored = rows.filter(F.col("path").rlike("^/profiles/[^/]+/lockedPaths$")).select(
        *SCOPE,
        F.regexp_extract("path", "^(/profiles/[^/]+)/", 1).alias("_entity"),
        F.from_json("value", "array<string>").alias("_locks"),
    )
    actions = (
        edits.filter("action is not null")
        .withColumn("_entity", _entity())
        .groupBy(*SCOPE, "_entity", "field_path")
        .agg(F.max_by("action", "edit_seq").alias("_last"), F.max("edit_seq").alias("edit_seq"))
        .groupBy(*SCOPE, "_entity")
        .agg(
            F.collect_set(F.when(F.col("_last") == "lock", F.col("field_path"))).alias("_on"),
            F.collect_set(F.when(F.col("_last") != "lock", F.col("field_path"))).alias("_off"),
            F.max("edit_seq").alias("edit_seq"),
        )
    )
    before = F.coalesce("_locks", F.array().cast("array<string>"))
    after = F.array_sort(F.array_except(F.array_union(before, F.col("_on")), F.col("_off")))
    locks = actions.join(stored, [*SCOPE, "_entity"], "left").select(
        *SCOPE,
        "edit_seq",
        F.concat("_entity", F.lit("/lockedPaths")).alias("path"),
        F.lit("replace").alias("op"),
        F.to_json(after).alias("value"),
    )
    entities = rows.select(*SCOPE, F.regexp_extract("path", "^(/profiles/[^/]+)", 1).alias("_entity")).distinct()
    new = (
        edits.filter("target = 'profile'")
        .withColumn("_entity", _entity())
        .groupBy(*SCOPE, "_entity")
        .agg(F.min("edit_seq").alias("edit_seq"), F.any_value("entity_id").alias("_id"))
        .join(entities, [*SCOPE, "_entity"], "left_anti")
        .select(
            *SCOPE,
            (F.col("edit_seq") - 1).alias("edit_seq"),
            F.concat("_entity", F.lit("/canonicalName")).alias("path"),
            F.lit("replace").alias("op"),
            _json_text(F.col("_id")).alias("value"),
        )
    )
    return (
        fields.unionByName(locks)
        .unionByName(new)
        .groupBy(*SCOPE, "path")
        .agg(F.max_by(F.struct("op", "value"), "edit_seq").alias("_e"))
        .select(*SCOPE, "path", "_e.op", F.when(F.col("_e.op") != "remove", "value").alias("kind"), "_e.value")
    )


def apply_overrides(rows: DataFrame, events: DataFrame) -> DataFrame:
    """State rows after the override events.

    An event replaces its path and all below it; an object value becomes its members.
    """
    state = rows.select(*SCOPE, "path", "kind", "value")
    above = state.select(*SCOPE, "path", F.explode(ancestors(F.col("path"), True)).alias("_at"))
    gone = above.join(events.select(*SCOPE, F.col("path").alias("_at")), [*SCOPE, "_at"], "left_semi")
    kept = state.join(gone.select(*SCOPE, "path").distinct(), [*SCOPE, "path"], "left_anti")
    written = events.filter("op <> 'remove'").select(*SCOPE, "path", "kind", "value")
    is_object = F.col("value").startswith("{")
    opened = flatten_documents(
        written.filter(is_object).withColumnRenamed("path", "_base"), [*SCOPE, "_base"], "value"
    ).select(*SCOPE, F.concat("_base", "path").alias("path"), "kind", "value")
    return kept.unionByName(written.filter(~F.coalesce(is_object, F.lit(False)))).unionByName(opened)


def replacement_nodes(heads: DataFrame, fingerprints: DataFrame, now: Column) -> DataFrame:
    """New nodes for edited heads: same floor, dependency and previous link, a later time.

    ``heads``: head nodes; ``fingerprints``: scope, state_fingerprint after the edits. The
    edited node stays in place; the newer one wins wherever both match.
    """
    changed = fingerprints.withColumnRenamed("state_fingerprint", "_new")
    node = F.concat(F.col("state_node_id"), F.lit(":edit:"), F.substring("_new", 8, 12))
    return heads.join(changed, SCOPE).select(
        *[c for c in heads.columns if c not in {"state_node_id", "state_fingerprint", "created_at", "status"}],
        node.alias("state_node_id"),
        F.col("_new").alias("state_fingerprint"),
        F.greatest(now, F.col("created_at") + 1).alias("created_at"),
        F.lit("stale").alias("status"),
        F.lit(True).alias("checkpoint"),
    )
