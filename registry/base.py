"""Shared inputs: how the supplied tables play the parts of chats, states and memories.

Each input exists twice, as a DataFrame and as a SQL text (a CTE body) that a second
engine can run on the same files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.keys import dependency_fingerprint, fingerprint
from turnledger.operators.floors import with_keys
from turnledger.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Block width used by ordered scans here: small, so that the supplied tables span many blocks.
BLOCK = 2048


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all tasks: a small file is one partition, whatever its rows are made into."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


_KEPT: dict[tuple[str, str, str], str] = {}


def kept(spark: SparkSession, sf: str, name: str, build: Query) -> DataFrame:
    """A derived table written once per session to the shared folder, as a deployment would
    keep it; it is written anew if the folder was cleared."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key in _KEPT:
        try:
            return spark.read.parquet(_KEPT[key])
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Fingerprints are hexadecimal digits: half the bytes, where the codec has an entropy stage.
    build(spark, sf).write.option("compression", "zstd").parquet(path)
    _KEPT[key] = path
    return spark.read.parquet(path)


# ---------------------------------------------------------------- chats

FLOORS_SQL = """
floors AS (
  SELECT CAST(conv_id AS VARCHAR) AS chat_id, 'main:' || conv_id AS branch_id,
         turn AS message_index, CAST(NULL AS INTEGER) AS swipe_id, text AS content,
         'sha256:' || sha256(text) AS body_fingerprint,
         'main:' || conv_id || ':' || conv_id || ':' || turn || ':0:sha256:' || sha256(text) AS floor_id
  FROM conversations WHERE role = 'assistant' AND text <> ''
)"""


def floors(spark: SparkSession, sf: str) -> DataFrame:
    chat = F.col("conv_id").cast("string")
    return with_keys(
        table(spark, sf, "conversations")
        .filter("role = 'assistant' and text <> ''")
        .select(
            chat.alias("chat_id"),
            F.concat(F.lit("main:"), chat).alias("branch_id"),
            F.col("turn").alias("message_index"),
            F.lit(None).cast("int").alias("swipe_id"),
            F.col("text").alias("content"),
        )
    )


# Stored variants: the floors, some of them stale, plus an older inactive swipe of a few.
STORED_SQL = (
    FLOORS_SQL
    + """,
stored AS (
  SELECT floor_id, chat_id, branch_id, message_index, swipe_id, body_fingerprint, content,
         TRUE AS active,
         CASE WHEN message_index % 4 = 3 THEN 'stale' ELSE 'synced' END AS status,
         TIMESTAMP '2026-01-01 00:00:00' AS created_at, TIMESTAMP '2026-01-01 00:00:00' AS updated_at
  FROM floors
  UNION ALL
  SELECT branch_id || ':' || chat_id || ':' || message_index || ':1:sha256:' || sha256(content || ' old'),
         chat_id, branch_id, message_index, 1, 'sha256:' || sha256(content || ' old'), content || ' old',
         FALSE, 'pending', TIMESTAMP '2025-12-01 00:00:00', TIMESTAMP '2025-12-01 00:00:00'
  FROM floors WHERE CAST(chat_id AS BIGINT) % 4 = 2
)"""
)


def stored(spark: SparkSession, sf: str) -> DataFrame:
    base = floors(spark, sf)
    new = base.select(
        "*",
        F.lit(True).alias("active"),
        F.when(F.col("message_index") % 4 == 3, "stale").otherwise("synced").alias("status"),
        F.lit("2026-01-01").cast("timestamp").alias("created_at"),
        F.lit("2026-01-01").cast("timestamp").alias("updated_at"),
    )
    old = with_keys(
        base.filter("cast(chat_id as bigint) % 4 = 2")
        .withColumn("swipe_id", F.lit(1))
        .withColumn("content", F.concat("content", F.lit(" old")))
    ).select(
        "*",
        F.lit(False).alias("active"),
        F.lit("pending").alias("status"),
        F.lit("2025-12-01").cast("timestamp").alias("created_at"),
        F.lit("2025-12-01").cast("timestamp").alias("updated_at"),
    )
    return new.unionByName(old)


# The next snapshot of nine chats in ten: deletions, edits and swipes.
INCOMING_SQL = """
incoming AS (
  SELECT chat_id, branch_id, message_index,
         CASE WHEN CAST(chat_id AS BIGINT) % 7 = 1 THEN 1 ELSE swipe_id END AS swipe_id,
         CASE WHEN CAST(chat_id AS BIGINT) % 3 = 0 THEN content || ' v2'
              WHEN CAST(chat_id AS BIGINT) % 7 = 1 THEN content || ' alt' ELSE content END AS content
  FROM floors WHERE message_index % 5 <> 0 AND CAST(chat_id AS BIGINT) % 10 <> 9
)"""


def incoming(spark: SparkSession, sf: str) -> DataFrame:
    chat = F.col("chat_id").cast("bigint")
    return (
        floors(spark, sf)
        .filter("message_index % 5 <> 0 and cast(chat_id as bigint) % 10 <> 9")
        .select(
            "chat_id",
            "branch_id",
            "message_index",
            F.when(chat % 7 == 1, F.lit(1)).otherwise(F.col("swipe_id")).alias("swipe_id"),
            F.when(chat % 3 == 0, F.concat("content", F.lit(" v2")))
            .when(chat % 7 == 1, F.concat("content", F.lit(" alt")))
            .otherwise(F.col("content"))
            .alias("content"),
        )
    )


REQUESTS_SQL = """
requests AS (
  SELECT CAST(conv_id AS VARCHAR) AS chat_id, 'main:' || conv_id AS branch_id,
         conv_id || ':' || turn AS query_id, turn AS user_index, text AS user_text
  FROM conversations WHERE role = 'user'
)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    chat = F.col("conv_id").cast("string")
    return (
        table(spark, sf, "conversations")
        .filter("role = 'user'")
        .select(
            chat.alias("chat_id"),
            F.concat(F.lit("main:"), chat).alias("branch_id"),
            F.concat_ws(":", chat, F.col("turn").cast("string")).alias("query_id"),
            F.col("turn").alias("user_index"),
            F.col("text").alias("user_text"),
        )
    )


# ---------------------------------------------------------------- memories

MEMORIES_SQL = """
memories AS (
  SELECT 'docs' AS chat_id, lang AS branch_id, CAST(doc_id AS VARCHAR) AS memory_id,
         CAST(doc_id AS BIGINT) AS start_floor, CAST(doc_id + n_chars % 7 AS BIGINT) AS end_floor,
         CASE WHEN doc_id % 3 = 0 THEN source || ' ' || lang END AS title, text AS summary,
         [lang, source] AS tags, [source] AS character_ids,
         CAST([] AS VARCHAR[]) AS plotline_ids, doc_id % 11 = 5 AS stale
  FROM documents
)"""


def memories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.lit("docs").alias("chat_id"),
        F.col("lang").alias("branch_id"),
        F.col("doc_id").cast("string").alias("memory_id"),
        F.col("doc_id").cast("bigint").alias("start_floor"),
        (F.col("doc_id") + F.col("n_chars") % 7).cast("bigint").alias("end_floor"),
        F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", "source", "lang")).alias("title"),
        F.col("text").alias("summary"),
        F.array("lang", "source").alias("tags"),
        F.array("source").alias("character_ids"),
        F.array().cast("array<string>").alias("plotline_ids"),
        (F.col("doc_id") % 11 == 5).alias("stale"),
    )


LANGS = ["en", "fr", "de", "es"]

SEARCHES_SQL = """
searches AS (
  SELECT 'docs' AS chat_id, unnest(['en', 'fr', 'de', 'es']) AS branch_id,
         CAST(item_id AS VARCHAR) AS query_id, text
  FROM benchmark WHERE text IS NOT NULL
)"""


def searches(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text asked in every language scope."""
    return (
        table(spark, sf, "benchmark")
        .filter("text is not null")
        .select(
            F.lit("docs").alias("chat_id"),
            F.explode(F.array(*[F.lit(x) for x in LANGS])).alias("branch_id"),
            F.col("item_id").cast("string").alias("query_id"),
            "text",
        )
    )


VECTORS_SQL = """
vectors AS (
  SELECT 'vecs' AS chat_id, 'label:' || label AS branch_id, CAST(vec_id AS VARCHAR) AS memory_id,
         CAST(vec_id AS BIGINT) AS start_floor, CAST(embedding AS DOUBLE[]) AS vector
  FROM embeddings
)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit("vecs").alias("chat_id"),
        F.concat(F.lit("label:"), F.col("label").cast("string")).alias("branch_id"),
        F.col("vec_id").cast("string").alias("memory_id"),
        F.col("vec_id").cast("bigint").alias("start_floor"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


# ---------------------------------------------------------------- state log

# Events of one user are the state log of one chat: nested paths, whole objects, removals.
LOG_SQL = """
log AS (
  SELECT CAST(user_id AS VARCHAR) AS chat_id, 'main:' || user_id AS branch_id, event_id AS seq,
         CASE WHEN event_type = 'error' THEN 'remove' ELSE 'replace' END AS op,
         CASE WHEN event_type = 'view' THEN '/story/now'
              WHEN event_type IN ('signup', 'error') THEN '/profiles/c' || (CAST(props->>'$.k' AS INTEGER) % 3)
              ELSE '/profiles/c' || (CAST(props->>'$.k' AS INTEGER) % 3) || '/' || event_type END AS path,
         CASE WHEN event_type = 'signup' THEN 'object' WHEN event_type <> 'error' THEN 'value' END AS kind,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type || ':' || (event_id % 4) END AS value
  FROM events
)"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    who = F.concat(
        F.lit("/profiles/c"),
        (F.get_json_object("props", "$.k").cast("int") % 3).cast("string"),
    )
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        user.alias("chat_id"),
        F.concat(F.lit("main:"), user).alias("branch_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "error", "remove").otherwise("replace").alias("op"),
        F.when(kind == "view", "/story/now")
        .when(kind.isin("signup", "error"), who)
        .otherwise(F.concat(who, F.lit("/"), kind))
        .alias("path"),
        F.when(kind == "signup", "object").when(kind != "error", "value").alias("kind"),
        F.when(
            kind.isin("view", "click", "purchase"),
            F.concat(kind, F.lit(":"), (F.col("event_id") % 4).cast("string")),
        ).alias("value"),
    )


# ---------------------------------------------------------------- state chain

# Every event is one analysed floor. Some nodes were made under an old prompt, some lost
# their predecessor, some floors have two nodes, some none.
CHAIN_SQL = """
event_floors AS (
  SELECT CAST(user_id AS VARCHAR) AS chat_id, 'main:' || user_id AS branch_id,
         event_id AS message_index, 'f' || event_id AS floor_id,
         'sha256:' || sha256(event_type || ':' || value) AS body_fingerprint,
         event_type || ':' || value AS content,
         CASE WHEN event_id % 17 = 0 THEN 'pending' ELSE 'synced' END AS status, user_id, event_id
  FROM events
),
linked AS (
  SELECT *, 'sha256:' || sha256('state:' || event_id) AS state_fingerprint,
         lag('sha256:' || sha256('state:' || event_id)) OVER (PARTITION BY user_id ORDER BY event_id) AS before
  FROM event_floors
),
nodes AS (
  SELECT chat_id, branch_id, floor_id, message_index, 'n' || event_id AS state_node_id,
         CASE WHEN user_id % 6 = 4 AND event_id % 13 = 4 THEN 'sha256:lost' ELSE before END AS previous_state_fingerprint,
         'sha256:' || sha256(body_fingerprint || chr(10)
           || CASE WHEN user_id % 6 = 4 AND event_id % 13 = 4 THEN 'sha256:lost' ELSE coalesce(before, '') END
           || chr(10) || '1' || chr(10) || '1' || chr(10)
           || CASE WHEN user_id % 6 = 5 AND event_id % 19 = 7 THEN 'p0' ELSE 'p1' END) AS dependency_fingerprint,
         state_fingerprint, 'synced' AS status, 1000000 + event_id AS created_at
  FROM linked WHERE NOT (user_id % 6 = 3 AND event_id % 23 = 11)
  UNION ALL
  SELECT chat_id, branch_id, floor_id, message_index, 'm' || event_id, before,
         'sha256:' || sha256(body_fingerprint || chr(10) || coalesce(before, '') || chr(10) || '1' || chr(10) || '1' || chr(10) || 'p1'),
         'sha256:' || sha256('other:' || event_id), 'stale', 2000000 + event_id
  FROM linked WHERE user_id % 6 = 2 AND event_id % 29 = 3
)"""


def event_floors(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    content = F.concat_ws(":", "event_type", F.col("value").cast("string"))
    return table(spark, sf, "events").select(
        user.alias("chat_id"),
        F.concat(F.lit("main:"), user).alias("branch_id"),
        F.col("event_id").alias("message_index"),
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("floor_id"),
        fingerprint(content).alias("body_fingerprint"),
        content.alias("content"),
        F.when(F.col("event_id") % 17 == 0, "pending").otherwise("synced").alias("status"),
        "user_id",
        "event_id",
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "state_nodes", _make_nodes)


def _make_nodes(spark: SparkSession, sf: str) -> DataFrame:
    from turnledger.operators.skew import previous_row

    # Events are put in order with their content; fingerprints are made afterwards, not shuffled.
    made = event_floors(spark, sf).select("chat_id", "branch_id", "message_index", "floor_id", "content", "user_id", "event_id")
    scope = ["chat_id", "branch_id"]

    def state(event: str) -> Column:
        return fingerprint(F.concat(F.lit("state:"), F.col(event).cast("string")))

    linked = previous_row(made, scope, "message_index", {"event_before": "event_id"}, BLOCK).select(
        "*",
        fingerprint(F.col("content")).alias("body_fingerprint"),
        state("event_id").alias("state_fingerprint"),
        F.when(F.col("event_before").isNotNull(), state("event_before")).alias("before"),
    )
    lost = (F.col("user_id") % 6 == 4) & (F.col("event_id") % 13 == 4)
    old = (F.col("user_id") % 6 == 5) & (F.col("event_id") % 19 == 7)
    event = F.col("event_id").cast("string")
    previous = F.when(lost, "sha256:lost").otherwise(F.col("before"))
    body = F.col("body_fingerprint")
    first = linked.filter("not (user_id % 6 = 3 and event_id % 23 = 11)").select(
        *scope,
        "floor_id",
        "message_index",
        F.concat(F.lit("n"), event).alias("state_node_id"),
        previous.alias("previous_state_fingerprint"),
        dependency_fingerprint(
            body, previous, F.when(old, "p0").otherwise("p1")
        ).alias("dependency_fingerprint"),
        "state_fingerprint",
        F.lit("synced").alias("status"),
        (F.lit(1000000) + F.col("event_id")).alias("created_at"),
    )
    second = linked.filter("user_id % 6 = 2 and event_id % 29 = 3").select(
        *scope,
        "floor_id",
        "message_index",
        F.concat(F.lit("m"), event).alias("state_node_id"),
        F.col("before").alias("previous_state_fingerprint"),
        dependency_fingerprint(body, F.col("before"), F.lit("p1")).alias("dependency_fingerprint"),
        fingerprint(F.concat(F.lit("other:"), event)).alias("state_fingerprint"),
        F.lit("stale").alias("status"),
        (F.lit(2000000) + F.col("event_id")).alias("created_at"),
    )
    return first.unionByName(second)
