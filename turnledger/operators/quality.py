"""Bulk validation of candidates, snapshots and manual edits against the rule table.

Documents are flattened to rows, each row is looked up in the (small, fixed) rule table by
its pattern, and every breach is one output row. Clean documents are an anti join away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from turnledger.functions import rules as r
from turnledger.functions.keys import ancestors, join_pointer, split_pointer
from turnledger.functions.text import non_blank, trim_ws
from turnledger.operators.skew import salted_join
from turnledger.operators.state_log import flatten_documents, open_documents


def rule_table(spark: SparkSession, rules: list[r.Rule]) -> DataFrame:
    schema = StructType(
        [
            StructField("pattern", StringType()),
            StructField("type", StringType()),
            StructField("allowed", ArrayType(StringType())),
        ]
    )
    return spark.createDataFrame(rules, schema)


def pattern_of(path: Column) -> Column:
    """Path with map keys as ``*`` and array positions as ``#``."""
    keyed = F.regexp_replace(path, r"^/(profiles|traces)/[^/]+", r"/$1/*")
    keyed = F.regexp_replace(keyed, r"^(/profiles/\*/sourcePriority)/[^/]+", r"$1/*")
    return F.regexp_replace(keyed, r"/\d+(?=/|$)", "/#")


def _json_type(value: Column) -> Column:
    return (
        F.when(value.startswith('"'), "string")
        .when(value.isin("true", "false"), "boolean")
        .when(value == "null", "null")
        .otherwise("number")
    )


def _breach(kind: Column, value: Column, type_: Column, allowed: Column) -> Column:
    text = F.when(value.startswith('"'), F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0])
    plain = F.coalesce(text, value)
    json_type = _json_type(value)
    return (
        F.when(type_ == "object", F.when(kind != "object", "must be an object"))
        .when(type_ == "array", F.when(kind != "array", "must be an array"))
        .when(
            type_ == "string",
            F.when(
                (kind != "value") | (json_type != "string") | non_blank(text).isNull(),
                "must be a non-empty string",
            ),
        )
        .when(type_ == "boolean", F.when((kind != "value") | (json_type != "boolean"), "must be boolean"))
        .when(
            type_ == "affinity",
            F.when(
                (kind != "value") | (json_type == "string") | ~F.array_contains(allowed, value),
                "must be an integer from -2 to 2 or null",
            ),
        )
        .when(
            type_ == "enum",
            F.when((kind != "value") | ~F.array_contains(allowed, plain), "is invalid"),
        )
    )


def _below_open(path: Column) -> Column:
    return path.rlike("^/profiles/[^/]+/nsfw/")


def _rules(spark: SparkSession, snapshot: bool) -> tuple[DataFrame, list[str]]:
    """The rule table with the ``required`` members of each pattern, and its patterns with a rule."""
    rules = r.snapshot_rules() if snapshot else r.candidate_rules()
    needed: dict[str, list[str]] = {}
    for pattern, field in dict.fromkeys(r.required_fields(snapshot)):
        needed.setdefault(pattern, []).append(field)
    ruled = {rule[0] for rule in rules}
    rows = [(*rule, needed.get(rule[0])) for rule in rules] + [(p, None, None, f) for p, f in needed.items() if p not in ruled]
    schema = "pattern string, type string, allowed array<string>, required array<string>"
    return spark.createDataFrame(rows, schema).coalesce(1), sorted(ruled)


def _violations(docs: DataFrame, keys: list[str], column: str, snapshot: bool, branch: str | None = None) -> DataFrame:
    """Breaches of the schema; with ``branch`` also ids and branches that do not fit.

    What a row breaches follows from the row, its path and the fixed rules, which are broadcast:
    documents are opened once, and their rows are never shuffled or met with each other.
    """
    held = list(dict.fromkeys([*keys, *([branch] if branch else [])]))
    rules, patterns = _rules(docs.sparkSession, snapshot)
    rows = open_documents(docs, held, column).withColumn("pattern", pattern_of(F.col("path")))
    joined = rows.join(F.broadcast(rules), "pattern", "left")
    path = F.col("path")

    def identity(p: Column) -> Column:
        return F.lit(False) if snapshot else (p != "") & F.element_at(split_pointer(p), -1).isin(r.IDENTITY_FIELDS)

    reason = (
        F.when(identity(path), "identity fields are supplied by the program")
        .when(F.col("type").isNull(), "is an unknown field")
        .otherwise(_breach(F.col("kind"), F.col("value"), F.col("type"), F.col("allowed")))
    )
    # Only the topmost breach is listed: what lies below an unknown field is not looked at.
    below_unknown = F.exists(ancestors(path), lambda p: ~pattern_of(p).isin(patterns) & ~identity(p))
    names = F.split("members", "/")
    missing = F.transform(
        F.filter(F.coalesce("required", F.array().cast("array<string>")), lambda f: ~F.array_contains(names, f)),
        lambda f: F.struct(F.concat(path, F.lit("/"), f).alias("path"), F.lit("is required").alias("reason")),
    )
    nothing = F.array().cast("array<struct<path:string,reason:string>>")

    def listed(reason: Column) -> Column:
        return F.when(reason.isNotNull(), F.array(F.struct(path.alias("path"), reason.alias("reason")))).otherwise(nothing)

    looked_at = F.col("kind").isNotNull() & ~_below_open(path)
    found = [
        listed(F.when(F.col("kind").isNull(), "is not JSON")),
        F.when(looked_at & F.col("_reason").isNotNull() & ~below_unknown, listed(F.col("_reason"))).otherwise(nothing),
        F.when(looked_at & (F.col("kind") == "object"), missing).otherwise(nothing),
    ]
    if branch:
        found.append(listed(_misplaced(F.col(branch))))
    checked = joined.withColumn("_reason", reason).select(*keys, F.explode(F.concat(*found)).alias("_f"))
    return checked.select(*keys, "_f.path", "_f.reason")


def _misplaced(branch: Column) -> Column:
    """Map keys must equal ids, and branches that of the document."""
    path, parts = F.col("path"), split_pointer(F.col("path"))
    quoted = F.concat(F.lit('"'), F.element_at(parts, 2), F.lit('"'))
    is_id = path.rlike("^/(profiles|traces)/[^/]+/characterId$")
    is_branch = path.rlike("(^|/source)/branchId$")
    text = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>")[0]
    return F.when(is_id & (F.col("value") != quoted), "must match the map key").when(
        is_branch & (text != branch), "does not match the current branch"
    )


def candidate_violations(
    docs: DataFrame, keys: list[str], column: str, locks: DataFrame | None = None
) -> DataFrame:
    """Breaches of the candidate schema, and writes at or below a locked path.

    ``locks``: keys of the document and a dotted ``locked_path`` (``profiles.id.basic.age``).
    """
    out = _violations(docs, keys, column, snapshot=False)
    if locks is None:
        return out
    guarded = docs.join(locks.select(*keys).distinct(), keys, "left_semi")
    rows = flatten_documents(guarded, keys, column, expand_arrays=True)
    probes = rows.select(
        *keys, "path", F.explode(ancestors(F.col("path"), include_self=True)).alias("_lock")
    )
    locked = locks.select(*keys, dotted_to_pointer(F.col("locked_path")).alias("_lock"))
    hit = probes.join(locked, [*keys, "_lock"], "left_semi").select(*keys, "path").distinct()
    return out.unionByName(hit.withColumn("reason", F.lit("is locked")))


def snapshot_violations(docs: DataFrame, keys: list[str], column: str, branch: str) -> DataFrame:
    """Breaches of the full schema; map keys must equal ids and branches the row's branch."""
    return _violations(docs, keys, column, snapshot=True, branch=branch)


def clean_documents(docs: DataFrame, violations: DataFrame, keys: list[str]) -> DataFrame:
    return docs.join(violations.select(*keys).distinct(), keys, "left_anti")


def normalize_snapshot_rows(rows: DataFrame, keys: list[str], branch: Column) -> DataFrame:
    """Trimmed map keys and ids, trimmed and deduplicated lists, current version and branch.

    ``rows`` are flattened with arrays as values.
    """
    parts = split_pointer(F.col("path"))
    entity = F.get(parts, 0).isin("profiles", "traces") & (F.size(parts) >= 2)
    trimmed = join_pointer(F.transform(parts, lambda p, i: F.when(i == 1, trim_ws(p)).otherwise(p)))
    lists = F.col("path").rlike("/(aliases|lockedPaths|sourceFloorIds|sourceHostChatIds)$")
    items = F.transform(F.from_json("value", "array<string>"), trim_ws)
    blank_allowed = F.col("path").rlike("/(sourceFloorIds|sourceHostChatIds)$")
    kept = F.array_distinct(F.when(blank_allowed, items).otherwise(F.filter(items, lambda x: x != "")))
    fresh_id = F.to_json(F.array(trim_ws(F.get(parts, 1))))
    identifier = F.col("path").rlike("^/(profiles|traces)/[^/]+/characterId$")
    source_branch = F.col("path").rlike("/source/branchId$")
    text = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>")[0]

    def quote(value: Column) -> Column:
        return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")

    value = (
        F.when(lists, F.to_json(kept))
        .when(identifier, F.regexp_replace(fresh_id, r"^\[|\]$", ""))
        .when(source_branch, quote(trim_ws(text)))
        .when(F.col("path") == "/schemaVersion", "1")
        .when(F.col("path") == "/branchId", quote(branch))
        .otherwise(F.col("value"))
    )
    return rows.withColumn("_value", value).select(
        *keys,
        F.when(entity, trimmed).otherwise(F.col("path")).alias("path"),
        "kind",
        F.col("_value").alias("value"),
    )


def dotted_to_pointer(path: Column) -> Column:
    """``profiles.a.list[0].x`` as a pointer."""
    plain = F.regexp_replace(F.regexp_replace(trim_ws(path), r"\[(\d+)\]", r".$1"), r"^\.", "")
    return F.concat(F.lit("/"), F.replace(plain, F.lit("."), F.lit("/")))


def locked_writes(changed: DataFrame, locks: DataFrame, keys: list[str]) -> DataFrame:
    """Changed paths equal to, under or above a locked path of the same document.

    Prefixes are exploded on both sides, so both tests are equality joins. They are merge joins:
    the planner takes an exploded side for as small as its file and would send it to the driver.
    """
    lock = dotted_to_pointer(F.col("locked_path"))
    write = changed.select(*keys, "path")
    at_or_under = write.withColumn("_p", F.explode(ancestors(F.col("path"), True)))
    locked = locks.select(*keys, lock.alias("_p")).distinct().hint("merge")
    above = locks.select(*keys, F.explode(ancestors(lock, True)).alias("path")).filter("path <> ''").distinct().hint("merge")
    spread = [F.col("path")]
    first = salted_join(at_or_under, locked, [*keys, "_p"], spread, "left_semi").select(*keys, "path")
    second = write.join(above, [*keys, "path"], "left_semi")
    return first.unionByName(second).distinct()


def manual_edit_violations(edits: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Why manual edits are rejected.

    ``edits``: edit_id, branch_id, current_branch_id, target, entity_id, path (dotted),
    value (JSON text), source_type, updated_at.
    """
    spark = edits.sparkSession
    table = rule_table(spark, r.candidate_rules())
    section = F.when(F.col("target") == "profile", "profiles").when(F.col("target") == "trace", "traces")
    relative = F.regexp_replace(F.regexp_replace(trim_ws(F.col("path")), r"\[(\d+)\]", r".$1"), r"^\.", "")
    segments = F.split(relative, r"\.")
    grammar = F.forall(segments, lambda s: s.rlike(r"^(\d+|[A-Za-z][A-Za-z0-9_]*)$"))
    body = F.replace(relative, F.lit("."), F.lit("/"))
    pointer = F.when(
        F.col("target") == "story", F.concat(F.lit("/story/"), body)
    ).otherwise(F.concat(F.lit("/"), section, F.lit("/"), F.col("entity_id"), F.lit("/"), body))
    keyed = edits.withColumn("_pointer", pointer).withColumn("pattern", pattern_of(F.col("_pointer")))
    joined = keyed.join(table, "pattern", "left")
    kind = F.when(F.col("value").startswith("{"), "object").when(F.col("value").startswith("["), "array").otherwise("value")
    forbidden = (F.col("target") == "profile") & F.arrays_overlap(
        segments, F.array(*[F.lit(x) for x in ("source", "branchId", "hostChatId")])
    )
    numeric = F.exists(segments, lambda s: s.rlike(r"^\d+$"))
    unsupported = F.col("type").isNull() | (F.col("target").isin("profile", "trace") & numeric)
    if locks is None:
        joined = joined.withColumn("_locked", F.lit(False))
    else:
        hits = locked_writes(
            keyed.select("edit_id", F.col("_pointer").alias("path")), locks, ["edit_id"]
        ).select("edit_id", F.lit(True).alias("_locked"))
        joined = joined.join(hits.distinct(), "edit_id", "left")
    reason = (
        F.when(non_blank(F.col("branch_id")).isNull(), "branchId must be a non-empty string")
        .when(F.col("branch_id") != F.col("current_branch_id"), "branchId does not match the current branch")
        .when(~F.coalesce(F.col("target").isin("profile", "trace", "story"), F.lit(False)), "target is invalid")
        .when((F.col("target") != "story") & non_blank(F.col("entity_id")).isNull(), "entityId must be a non-empty string")
        .when(non_blank(F.col("path")).isNull(), "path must be a non-empty string")
        .when(F.coalesce("_locked", F.lit(False)), "path is locked")
        .when(~grammar, "path contains an invalid segment")
        .when(forbidden, "path cannot target identity or source fields")
        .when(unsupported, "path is not a supported schema path")
        .otherwise(
            F.coalesce(
                F.concat(F.lit("value "), _breach(kind, F.col("value"), F.col("type"), F.col("allowed"))),
                F.when(F.coalesce("source_type", F.lit("story")) != "manual", "source type must be manual"),
                F.when(non_blank(F.col("updated_at").cast("string")).isNull(), "updatedAt must be a non-empty string"),
            )
        )
    )
    return joined.withColumn("reason", reason).filter("reason is not null").select("edit_id", "reason")
