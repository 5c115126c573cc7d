"""Validation, parsing and merging jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.base import LOG_SQL, dealt, log, query, table
from turnledger.functions.parse import canonical_base_url, extract_json_objects, path_exists
from turnledger.operators import merge as mg
from turnledger.operators import quality as ql
from turnledger.operators import state_log as sl
from turnledger.operators.floors import SCOPE

# ---------------------------------------------------------------- candidates

# One candidate per event; ten kinds, eight of them wrong in one way.
_CASES = [
    '{"profiles":{"c1":{"basic":{"age":"20","color":"red"}}}}',
    '{"profiles":{"c1":{"basic":{"age":20}}}}',
    '{"traces":{"c1":{"affinity":{"inner":3,"outer":null}}}}',
    '{"story":{"now":{"currentTime":"Day 1"},"floorId":"x"}}',
    '{"profiles":{"c1":{"canonicalName":"   ","aliases":["A"]}}}',
    '{"traces":{"c1":{"currentSituations":[{"id":"s"}]}}}',
    '{"profiles":{"c1":{"aliases":"A"}},"notes":["n"]}',
    '{"story":{"calendar":[{"id":"d","dateKey":"2026-01-01","type":"party","title":"T","confirmed":true}]}}',
    '{"profiles":{"c1":{"nsfw":{"any":{"thing":1}},"sourcePriority":{"basic.age":"story"}}}}',
    '{"profiles":{"c2":{"basic":{"age":"30"}}}}',
]
_FOUND_SQL = """
SELECT event_id, path, reason FROM events JOIN (VALUES
  (0, '/profiles/c1/basic/color', 'is an unknown field'),
  (1, '/profiles/c1/basic/age', 'must be a non-empty string'),
  (2, '/traces/c1/affinity/inner', 'must be an integer from -2 to 2 or null'),
  (3, '/story/floorId', 'identity fields are supplied by the program'),
  (4, '/profiles/c1/canonicalName', 'must be a non-empty string'),
  (5, '/traces/c1/currentSituations/0/text', 'is required'),
  (6, '/profiles/c1/aliases', 'must be an array'),
  (7, '/story/calendar/0/type', 'is invalid'),
  (9, '/profiles/c2/basic', 'is locked'),
  (9, '/profiles/c2/basic/age', 'is locked')) v(c, path, reason) ON event_id % 10 = c"""


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    texts = F.array(*[F.lit(t) for t in _CASES])
    docs = dealt(table(spark, sf, "events").select("event_id"), "event_id").select(
        "event_id", F.element_at(texts, (F.col("event_id") % 10 + 1).cast("int")).alias("candidate")
    )
    locks = docs.filter("event_id % 10 in (8, 9)").select(
        "event_id", F.lit("profiles.c2.basic").alias("locked_path")
    )
    return docs, locks


@query("candidate_violations", _FOUND_SQL)
def candidate_violations(spark: SparkSession, sf: str) -> DataFrame:
    docs, locks = _candidates(spark, sf)
    return ql.candidate_violations(docs, ["event_id"], "candidate", locks)


@query("clean_candidates", "SELECT event_id FROM events WHERE event_id % 10 = 8")
def clean_candidates(spark: SparkSession, sf: str) -> DataFrame:
    docs, locks = _candidates(spark, sf)
    found = ql.candidate_violations(docs, ["event_id"], "candidate", locks)
    return ql.clean_documents(docs, found, ["event_id"]).select("event_id")


# ---------------------------------------------------------------- snapshots

_SOURCE = '{"branchId":"B","sourceFloorIds":["f"],"sourceHostChatIds":["h"],"sourceType":"story"}'
_SNAPSHOT = (
    '{"schemaVersion":1,"branchId":"B","updatedAt":"t","traces":{},"profiles":{"K":{"characterId":"I","canonicalName":"N",'
    '"aliases":[" a ","a"," "],"basic":{},"appearance":{},"identity":{},"personality":{},"lifeDetails":[],"lockedPaths":[],'
    '"sourcePriority":{},"source":' + _SOURCE + ',"updatedAt":"t"}},"story":{"now":{"ongoing":[],"upcoming":[]},'
    '"calendar":[],"plotlines":[],"plotPlans":[],"source":' + _SOURCE + "}}"
)


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: a wrong branch, a wrong id, a missing section, a wrong version, or fine."""
    key = F.col("c_custkey")
    text = F.replace(F.lit(_SNAPSHOT), F.lit('"N"'), F.concat(F.lit('"'), "c_name", F.lit('"')))
    text = F.replace(text, F.lit('"K":'), F.concat(F.lit('" c'), key.cast("string"), F.lit('":')))
    text = F.replace(text, F.lit('"I"'), F.concat(F.lit('" c'), F.when(key % 5 == 1, "x").otherwise(key.cast("string")), F.lit('"')))
    text = F.replace(text, F.lit('" a ","a"," "'), F.lit('" a ","a"'))
    text = F.when(key % 5 == 2, F.replace(text, F.lit('"traces":{},'), F.lit(""))).otherwise(text)
    text = F.when(key % 5 == 3, F.replace(text, F.lit('"schemaVersion":1'), F.lit('"schemaVersion":2'))).otherwise(text)
    return dealt(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").select(
        "c_custkey", F.when(key % 5 == 4, "other").otherwise("B").alias("branch_id"), text.alias("doc")
    )


@query(
    "snapshot_violations",
    """
SELECT c_custkey, '/profiles/ c' || c_custkey || '/characterId' AS path, 'must match the map key' AS reason FROM customer WHERE c_custkey % 5 = 1
UNION ALL SELECT c_custkey, '/traces', 'is required' FROM customer WHERE c_custkey % 5 = 2
UNION ALL SELECT c_custkey, '/schemaVersion', 'is invalid' FROM customer WHERE c_custkey % 5 = 3
UNION ALL SELECT c_custkey, unnest(['/branchId', '/story/source/branchId', '/profiles/ c' || c_custkey || '/source/branchId']), 'does not match the current branch'
FROM customer WHERE c_custkey % 5 = 4""",
)
def snapshot_violations(spark: SparkSession, sf: str) -> DataFrame:
    return ql.snapshot_violations(_snapshots(spark, sf), ["c_custkey"], "doc", "branch_id").select(
        "c_custkey", "path", "reason"
    )


@query(
    "snapshot_normalization",
    """
SELECT c_custkey, '/profiles/c' || c_custkey || '/characterId' AS path, '"c' || c_custkey || '"' AS value FROM customer
UNION ALL SELECT c_custkey, '/profiles/c' || c_custkey || '/aliases', '["a"]' FROM customer
UNION ALL SELECT c_custkey, '/schemaVersion', '1' FROM customer
UNION ALL SELECT c_custkey, '/branchId', CASE WHEN c_custkey % 5 = 4 THEN '"other"' ELSE '"B"' END FROM customer""",
)
def snapshot_normalization(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["c_custkey", "branch_id"]
    rows = sl.flatten_documents(_snapshots(spark, sf), keys, "doc")
    out = ql.normalize_snapshot_rows(rows, keys, F.col("branch_id"))
    shown = out.filter(F.col("path").rlike("(characterId|aliases|schemaVersion)$|^/branchId$"))
    return shown.select("c_custkey", "path", "value")


# ---------------------------------------------------------------- manual edits

_EDITS = [
    ("profile", "basic.age", '"21"', "manual"),
    ("profile", "basic.age", "21", "manual"),
    ("profile", "source.branchId", '"x"', "manual"),
    ("trace", "affinity.inner", "5", "manual"),
    ("story", "plotlines[0].pinned", '"yes"', "manual"),
    ("story", "calendar.0.confirmed", "true", "manual"),
    ("world", "x", '"y"', "manual"),
    ("profile", "canonicalName", '"N"', "story"),
    ("profile", "basic", "{}", "manual"),
    ("story", "now.-bad", '"x"', "manual"),
]


def _edits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cases = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("tpvs", e)]) for e in _EDITS])
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("edit_id"),
        F.lit("B").alias("branch_id"),
        F.when(F.col("event_id") % 100 == 5, "other").otherwise("B").alias("current_branch_id"),
        F.element_at(cases, (F.col("event_id") % 10 + 1).cast("int")).alias("_e"),
        F.lit("c1").alias("entity_id"),
        F.lit("t").alias("updated_at"),
    )
    edits = rows.select(
        "edit_id", "branch_id", "current_branch_id", "entity_id", "updated_at",
        F.col("_e.t").alias("target"), F.col("_e.p").alias("path"),
        F.col("_e.v").alias("value"), F.col("_e.s").alias("source_type"),
    )
    locks = rows.filter("edit_id % 10 = 8").select(
        "edit_id", F.lit("profiles.c1.basic.age").alias("locked_path")
    )
    return edits, locks


@query(
    "manual_edit_validation",
    """
SELECT event_id AS edit_id, CASE WHEN event_id % 100 = 5 THEN 'branchId does not match the current branch' ELSE reason END AS reason
FROM events JOIN (VALUES (1, 'value must be a non-empty string'), (2, 'path cannot target identity or source fields'),
  (3, 'value must be an integer from -2 to 2 or null'), (4, 'value must be boolean'), (5, NULL), (6, 'target is invalid'),
  (7, 'source type must be manual'), (8, 'path is locked'), (9, 'path contains an invalid segment')) v(c, reason) ON event_id % 10 = c
WHERE reason IS NOT NULL OR event_id % 100 = 5""",
)
def manual_edit_validation(spark: SparkSession, sf: str) -> DataFrame:
    return ql.manual_edit_violations(*_edits(spark, sf))


# ---------------------------------------------------------------- identities and merging

# Customers of a nation are the characters of a scope; orders mention them in several spellings.
_KNOWN_SQL = """
WITH known AS (
  SELECT 'world' AS chat_id, CAST(c_nationkey AS VARCHAR) AS branch_id, 'c' || c_custkey AS character_id, c_name AS canonical_name,
         'Friend ' || (c_custkey % 100) AS alias, c_custkey AS ordinal
  FROM customer
),
mentions AS (
  SELECT o_orderkey, CAST(c_nationkey AS VARCHAR) AS branch_id, o_custkey,
    CASE o_orderkey % 4 WHEN 0 THEN '  C' || o_custkey || ' ' WHEN 1 THEN upper(c_name) WHEN 2 THEN 'friend ' || (o_custkey % 100) ELSE ' Stranger ' END AS raw
  FROM orders JOIN customer ON c_custkey = o_custkey
)"""


def _known(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.lit("world").alias("chat_id"),
        F.col("c_nationkey").cast("string").alias("branch_id"),
        F.concat(F.lit("c"), key.cast("string")).alias("character_id"),
        F.col("c_name").alias("canonical_name"),
        F.array(F.concat(F.lit("Friend "), (key % 100).cast("string"))).alias("aliases"),
        key.alias("ordinal"),
    )


@query(
    "identity_resolution",
    _KNOWN_SQL
    + """,
keys AS (
  SELECT branch_id, key, min_by(character_id, ordinal) AS character_id FROM (
    SELECT branch_id, lower(character_id) AS key, character_id, ordinal FROM known
    UNION ALL SELECT branch_id, lower(canonical_name), character_id, ordinal FROM known
    UNION ALL SELECT branch_id, lower(alias), character_id, ordinal FROM known) GROUP BY ALL
)
SELECT m.o_orderkey, coalesce(k.character_id, trim(m.raw)) AS character_id
FROM mentions m LEFT JOIN keys k ON k.branch_id = m.branch_id AND k.key = lower(trim(m.raw))""",
)
def identity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"
    )
    case, cust = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    raw = (
        F.when(case == 0, F.concat(F.lit("  C"), cust, F.lit(" ")))
        .when(case == 1, F.upper("c_name"))
        .when(case == 2, F.concat(F.lit("friend "), (F.col("o_custkey") % 100).cast("string")))
        .otherwise(" Stranger ")
    )
    mentions = table(spark, sf, "orders").join(people, "o_custkey").select(
        F.lit("world").alias("chat_id"),
        F.col("c_nationkey").cast("string").alias("branch_id"),
        "o_orderkey",
        raw.alias("raw"),
    )
    return mg.resolve_identities(mentions, _known(spark, sf)).select("o_orderkey", "character_id")


def _character_rows(spark: SparkSession, sf: str) -> DataFrame:
    """State rows of the customers: names and aliases for most, a trace only for some."""
    key = F.col("c_custkey")
    who = F.concat(F.lit("c"), key.cast("string"))

    def row(path, value) -> F.Column:
        return F.struct(path.alias("path"), value.alias("value"))

    profile = F.array(
        row(F.concat(F.lit("/profiles/"), who, F.lit("/canonicalName")), F.concat(F.lit('"'), "c_name", F.lit('"'))),
        row(F.concat(F.lit("/profiles/"), who, F.lit("/aliases")), F.concat(F.lit('["F'), key.cast("string"), F.lit('"]'))),
        row(F.concat(F.lit("/profiles/"), who, F.lit("/lockedPaths")), F.lit('["basic.age","identity"]')),
    )
    trace = F.array(row(F.concat(F.lit("/traces/"), who, F.lit("/affinity/inner")), F.lit("1")))
    rows = F.when(key % 4 == 0, trace).when(key % 4 == 1, F.concat(profile, trace)).otherwise(profile)
    return table(spark, sf, "customer").select(
        F.lit("world").alias("chat_id"),
        F.col("c_nationkey").cast("string").alias("branch_id"),
        F.inline(rows),
    )


@query(
    "known_characters",
    """
SELECT CAST(c_nationkey AS VARCHAR) AS branch_id, 'c' || c_custkey AS character_id,
       CASE WHEN c_custkey % 4 = 0 THEN 'c' || c_custkey ELSE c_name END AS canonical_name,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'F' || c_custkey END AS aliases, c_custkey % 4 <> 0 AS has_profile
FROM customer""",
)
def known_characters(spark: SparkSession, sf: str) -> DataFrame:
    out = mg.known_characters(_character_rows(spark, sf))
    return out.withColumn("aliases", F.array_join("aliases", ",")).drop("chat_id")


@query(
    "locked_paths",
    """
SELECT CAST(c_nationkey AS VARCHAR) AS branch_id, 'profiles.c' || c_custkey || '.' || unnest(['basic.age', 'identity']) AS locked_path
FROM customer WHERE c_custkey % 4 <> 0""",
)
def locked_paths(spark: SparkSession, sf: str) -> DataFrame:
    return mg.locked_paths(_character_rows(spark, sf)).drop("chat_id")


# Patches: orders set fields of their customer; some say nothing, some repeat a value.
_PATCH_SQL = """
WITH base AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS branch_id, '/profiles/c' || c_custkey || '/canonicalName' AS path, '"' || c_name || '"' AS value
  FROM customer WHERE c_custkey % 3 <> 0
),
patches AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS branch_id, 'c' || o_custkey AS who, o_orderkey AS seq,
    CASE o_orderkey % 5 WHEN 0 THEN '/profiles/c' || o_custkey || '/basic/age' WHEN 1 THEN '/profiles/c' || o_custkey || '/basic/age'
      WHEN 2 THEN '/traces/c' || o_custkey || '/affinity/inner' WHEN 3 THEN '/profiles/c' || o_custkey || '/aliases' ELSE '/profiles/c' || o_custkey || '/basic/race' END AS path,
    CASE o_orderkey % 5 WHEN 0 THEN '" ' || o_orderkey || ' "' WHEN 1 THEN '"  "' WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '1' END
      WHEN 3 THEN '[" x","x"," ","' || o_orderstatus || '"]' ELSE 'null' END AS value, o_orderkey % 5 AS c, o_orderkey, o_orderstatus
  FROM orders JOIN customer ON c_custkey = o_custkey
),
said AS (
  SELECT branch_id, who, seq, path, CASE c WHEN 0 THEN '"' || o_orderkey || '"' WHEN 2 THEN value WHEN 3 THEN '["x","' || o_orderstatus || '"]' END AS value
  FROM patches WHERE c IN (0, 2, 3)
),
stubs AS (
  SELECT branch_id, '/profiles/' || who || '/canonicalName' AS path, '"' || who || '"' AS value, min(seq) AS seq
  FROM said s WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.branch_id = s.branch_id AND starts_with(b.path, '/profiles/' || s.who || '/'))
  GROUP BY branch_id, who
)
"""


@query(
    "candidate_merge",
    _PATCH_SQL
    + """
SELECT branch_id, path, max_by(value, seq) AS value, max(seq) AS source_seq FROM said GROUP BY ALL
UNION ALL SELECT branch_id, path, value, seq FROM stubs
UNION ALL SELECT branch_id, path, value, NULL FROM base""",
)
def candidate_merge(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer")
    scope = [F.lit("world").alias("chat_id"), F.col("c_nationkey").cast("string").alias("branch_id")]
    base = people.filter("c_custkey % 3 <> 0").select(
        *scope,
        F.concat(F.lit("/profiles/c"), F.col("c_custkey").cast("string"), F.lit("/canonicalName")).alias("path"),
        F.concat(F.lit('"'), "c_name", F.lit('"')).alias("value"),
    )
    key, case = F.col("o_orderkey"), F.col("o_orderkey") % 5
    who = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))

    def at(section: str, field: str) -> F.Column:
        return F.concat(F.lit(f"/{section}/"), who, F.lit(f"/{field}"))

    path = (
        F.when(case <= 1, at("profiles", "basic/age"))
        .when(case == 2, at("traces", "affinity/inner"))
        .when(case == 3, at("profiles", "aliases"))
        .otherwise(at("profiles", "basic/race"))
    )
    value = (
        F.when(case == 0, F.concat(F.lit('" '), key.cast("string"), F.lit(' "')))
        .when(case == 1, '"  "')
        .when(case == 2, F.when(key % 2 == 0, "null").otherwise("1"))
        .when(case == 3, F.concat(F.lit('[" x","x"," ","'), "o_orderstatus", F.lit('"]')))
        .otherwise("null")
    )
    joined = table(spark, sf, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    patches = joined.select(*scope, key.alias("seq"), path.alias("path"), value.alias("value"))
    return mg.merge_patches(base, patches).drop("chat_id")


@query(
    "lock_enforcement",
    """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/profiles/c' || o_custkey || '/basic/age' WHEN 1 THEN '/profiles/c' || o_custkey || '/identity/background'
  ELSE '/profiles/c' || o_custkey END AS path
FROM orders WHERE o_orderkey % 4 <> 3 AND o_custkey % 4 <> 0""",
)
def lock_enforcement(spark: SparkSession, sf: str) -> DataFrame:
    """Each order writes two paths of its customer: equal to, under, above a lock, or free."""
    case, who = F.col("o_orderkey") % 4, F.concat(F.lit("/profiles/c"), F.col("o_custkey").cast("string"))
    first = (
        F.when(case == 0, F.concat(who, F.lit("/basic/age")))
        .when(case == 1, F.concat(who, F.lit("/identity/background")))
        .when(case == 2, who)
        .otherwise(F.concat(who, F.lit("/basic/race")))
    )
    orders = table(spark, sf, "orders")
    writes = orders.select("o_orderkey", F.explode(F.array(first, F.concat(who, F.lit("/zeal")))).alias("path"))
    dotted = F.concat(F.lit("profiles.c"), F.col("o_custkey").cast("string"))
    locks = orders.filter("o_custkey % 4 <> 0").select(
        "o_orderkey",
        F.explode(F.array(F.concat(dotted, F.lit(".basic.age")), F.concat(dotted, F.lit(".identity")))).alias("locked_path"),
    )
    return mg.enforce_locks(writes, locks, ["o_orderkey"])[1]


@query(
    "provenance_merge",
    """
SELECT o_custkey, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS content,
  CASE WHEN o_orderkey % 7 = 0 THEN 'now' WHEN o_orderkey % 3 = 0 THEN array_to_string(list_transform(range(1, o_orderkey % 60 + 2), lambda x: 's' || x), ',')
       ELSE array_to_string((list_filter(list_transform(range(1, o_orderkey % 60 + 2), lambda x: 's' || x), lambda s: s <> 's' || (o_orderkey % 5)) || ['s' || (o_orderkey % 5)])[-50:], ',') END AS sources
FROM orders""",
)
def provenance_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Items by order: unchanged, edited with up to sixty earlier sources, or new."""
    key = F.col("o_orderkey")
    ids = F.transform(F.sequence(F.lit(1), (key % 60 + 1).cast("int")), lambda x: F.concat(F.lit("s"), x.cast("string")))
    orders = table(spark, sf, "orders")
    previous = orders.filter(key % 7 != 0).select(
        "o_custkey", key.alias("id"), F.lit("a").alias("content"), ids.alias("source_ids")
    )
    incoming = orders.select(
        "o_custkey",
        key.alias("id"),
        F.when(key % 3 == 0, "a").otherwise("b").alias("content"),
        F.when(key % 7 == 0, "now").otherwise(F.concat(F.lit("s"), (key % 5).cast("string"))).alias("source_id"),
    )
    out = mg.merge_collection(previous, incoming, ["o_custkey"])
    return out.select("o_custkey", "id", "content", F.array_join("source_ids", ",").alias("sources"))


@query(
    "change_sections",
    f"""
WITH {LOG_SQL}
SELECT chat_id, split_part(path, '/', 2) AS section, count(*) AS changes FROM log GROUP BY ALL""",
)
def change_sections(spark: SparkSession, sf: str) -> DataFrame:
    return (
        log(spark, sf)
        .groupBy("chat_id", sl.partition_of(F.col("path")).alias("section"))
        .agg(F.count(F.lit(1)).alias("changes"))
    )


# ---------------------------------------------------------------- parsing jobs


@query(
    "json_output_extraction",
    """
SELECT doc_id, CASE WHEN doc_id % 8 IN (0, 1, 2, 3) THEN '{"id":' || doc_id || ',"lang":"' || lang || '"}' END AS json,
  CASE doc_id % 8 WHEN 4 THEN 'unterminated reasoning block' WHEN 5 THEN 'empty' WHEN 6 THEN 'not an object' WHEN 7 THEN 'not valid JSON' END AS reason
FROM documents""",
)
def json_output_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Answers wrapped in reasoning, fences or the document's own prose, and broken ones."""
    doc, case = F.col("doc_id").cast("string"), F.col("doc_id") % 8
    body = F.concat(F.lit('{"lang": "'), "lang", F.lit('", "id": '), doc, F.lit("}"))
    smart = F.concat(F.lit("{“lang”: “"), "lang", F.lit("”, “id”: "), doc, F.lit(",}"))
    prose = F.translate("text", "{}`<", "")
    raw = (
        F.when(case == 0, F.concat(F.lit("<think>{ not this }</think>\n"), body))
        .when(case == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n``` "), prose))
        .when(case == 2, F.concat(prose, F.lit(" "), body, F.lit(" "), prose))
        .when(case == 3, smart)
        .when(case == 4, F.concat(F.lit("<think> "), body))
        .when(case == 5, " \n ")
        .when(case == 6, F.concat(F.lit("["), doc, F.lit(", 1]")))
        .otherwise(F.concat(F.lit("{ broken "), prose))
    )
    answers = table(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    return extract_json_objects(answers, "raw").drop("raw")


@query(
    "base_url_canonical",
    """
SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL WHEN 2 THEN origin || '/v1' ELSE origin || CASE WHEN path IN ('', '/') THEN '/v1' ELSE rtrim(path, '/') END END AS base_url
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS origin, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) AS path FROM pages)""",
)
def base_url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    case = F.col("page_id") % 4
    origin = F.regexp_extract("url", "^https?://[^/?#]+", 0)
    path = F.regexp_extract("url", "^https?://[^/?#]+(/[^?#]*)?", 1)
    tail = F.regexp_replace("url", "^https?://[^?#]+", "")
    raw = (
        F.when(case == 1, F.concat(F.lit(" "), F.upper(origin), F.rtrim(path, F.lit("/")), F.lit("/chat/completions//"), tail))
        .when(case == 2, F.concat(origin, F.lit("///")))
        .when(case == 3, F.concat(F.lit("ftp://"), "url"))
        .otherwise(F.col("url"))
    )
    return table(spark, sf, "pages").select("page_id", canonical_base_url(raw).alias("base_url"))


@query(
    "json_path_exists",
    """
SELECT event_id, event_id % 5 IN (0, 1, 4) AS found FROM events""",
)
def json_path_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Paths into the event properties: a field, an array item, a missing one, a null leaf, a
    member with a number for a name."""
    case = F.col("event_id") % 5
    doc = F.concat(F.lit('{"p":'), "props", F.lit(',"list":[{"x":1}],"none":null,"a":{"0":1}}'))
    path = F.when(case == 0, "p.k").when(case == 1, "list[0].x").when(case == 2, "list[3].x").when(case == 3, "none").otherwise("a.0")
    return table(spark, sf, "events").select("event_id", path_exists(doc, path).alias("found"))
