"""The state log: replay, versions, diffs, fingerprints, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from registry.base import BLOCK, LOG_SQL, kept, log, query, table
from turnledger.operators import checkpoints as cp
from turnledger.operators import state_log as sl
from turnledger.operators.floors import SCOPE
from turnledger.session import scratch_dir

# Life span of each row: until the next change of its path or of the path above it.
_VERSIONS_SQL = f"""
WITH {LOG_SQL},
versions AS (
  SELECT l.chat_id, l.branch_id, l.path, l.kind, l.value, l.seq AS valid_from,
         (SELECT min(c.seq) FROM log c WHERE c.chat_id = l.chat_id AND c.seq > l.seq
            AND (c.path = l.path OR starts_with(l.path, c.path || '/'))) AS valid_to
  FROM log l WHERE l.op <> 'remove'
)"""


@query(
    "latest_state",
    _VERSIONS_SQL
    + " SELECT chat_id, branch_id, path, kind, value, valid_from AS seq FROM versions WHERE valid_to IS NULL",
)
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return sl.latest_state(log(spark, sf))


@query(
    "state_replay_until",
    _VERSIONS_SQL
    + """,
ends AS (SELECT chat_id, max(seq) - max(seq) % 1000 - 500 AS at_seq FROM log GROUP BY chat_id)
SELECT v.chat_id, path, kind, value FROM versions v JOIN ends e ON e.chat_id = v.chat_id
WHERE valid_from <= at_seq AND (valid_to IS NULL OR valid_to > at_seq)""",
)
def state_replay_until(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf)
    until = rows.groupBy(*SCOPE).agg(
        (F.max("seq") - F.max("seq") % 1000 - 500).alias("at_seq")
    )
    return sl.latest_state(rows, until).select("chat_id", "path", "kind", "value")


@query("state_versions", _VERSIONS_SQL + " SELECT * FROM versions")
def state_versions(spark: SparkSession, sf: str) -> DataFrame:
    return sl.state_versions(log(spark, sf), BLOCK)


_POINTS_SQL = """,
points AS (SELECT chat_id, CAST(seq AS VARCHAR) AS query_id, seq AS at_seq FROM log)"""


def _every_seq(rows: DataFrame) -> DataFrame:
    return rows.select(*SCOPE, F.col("seq").cast("string").alias("query_id"), F.col("seq").alias("at_seq"))


@query(
    "state_as_of",
    _VERSIONS_SQL
    + _POINTS_SQL
    + """
SELECT v.chat_id, p.query_id, v.path, v.kind, v.value FROM versions v
JOIN points p ON p.chat_id = v.chat_id AND v.valid_from <= p.at_seq AND (v.valid_to IS NULL OR v.valid_to > p.at_seq)""",
)
def state_as_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf)
    points = _every_seq(rows)
    versions = sl.state_versions(rows, BLOCK)
    return sl.state_at(versions, points, sl.last_seq(rows), 1000).select(
        "chat_id", "query_id", "path", "kind", "value"
    )


_WORDS_SQL = """
  bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS w0, bit_xor(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS w1,
  bit_xor(CAST('0x' || substr(h, 31, 15) AS BIGINT)) AS w2, bit_xor(CAST('0x' || substr(h, 46, 15) AS BIGINT)) AS w3"""
_HASH_SQL = "sha256(path || chr(10) || kind || chr(10) || coalesce(value, ''))"
_FP_SQL = "'sha256:' || sha256(w0 || ':' || w1 || ':' || w2 || ':' || w3)"


@query(
    "semantic_fingerprint",
    _VERSIONS_SQL
    + f""",
rows AS (
  SELECT chat_id, branch_id, path, kind, value FROM versions WHERE valid_to IS NULL
  UNION ALL
  SELECT DISTINCT chat_id, branch_id, '/story/plotlines', 'value', '[{{"id":"p' || chat_id || '"}},{{"t":[1]}},{{}}]' FROM log
),
hashed AS (SELECT chat_id, branch_id, {_HASH_SQL} AS h FROM rows),
words AS (SELECT chat_id, branch_id, {_WORDS_SQL} FROM hashed GROUP BY ALL)
SELECT chat_id, branch_id, {_FP_SQL} AS state_fingerprint FROM words""",
)
def semantic_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = sl.latest_state(log(spark, sf))
    noise = rows.filter("kind = 'value'").withColumn(
        "path", F.concat("path", F.lit("/updatedAt"))
    )
    # Items of a list carry provenance too.
    items = F.concat(
        F.lit('[{"id":"p'), "chat_id", F.lit('","sourceFloorIds":["f]1","f,2"],"updatedAt":"'), F.col("_at").cast("string"),
        F.lit('"},{"source":{"type":"ai","seen":[{"floor":1}]},"t":[1]},{"updatedAt":null}]'),
    )
    lists = log(spark, sf).groupBy(*SCOPE).agg(F.max("seq").alias("_at")).select(
        *SCOPE, F.lit("/story/plotlines").alias("path"), F.lit("value").alias("kind"), items.alias("value"), F.col("_at").alias("seq")
    )
    return sl.state_fingerprints(rows.unionByName(noise).unionByName(lists), SCOPE)


@query(
    "state_node_fingerprints",
    _VERSIONS_SQL
    + f""",
floors AS (SELECT DISTINCT chat_id, branch_id, seq FROM log),
hashed AS (
  SELECT f.chat_id, f.branch_id, f.seq, {_HASH_SQL} AS h FROM floors f JOIN versions v
    ON v.chat_id = f.chat_id AND v.valid_from <= f.seq AND (v.valid_to IS NULL OR v.valid_to > f.seq)
),
words AS (SELECT chat_id, branch_id, seq, {_WORDS_SQL} FROM hashed GROUP BY ALL),
zero AS (SELECT {_FP_SQL} AS empty FROM (SELECT 0 AS w0, 0 AS w1, 0 AS w2, 0 AS w3))
SELECT f.chat_id, f.branch_id, f.seq, coalesce({_FP_SQL.replace("w", "w.w")}, (SELECT empty FROM zero)) AS state_fingerprint
FROM floors f LEFT JOIN words w ON w.chat_id = f.chat_id AND w.seq = f.seq""",
)
def state_node_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf)
    return sl.node_fingerprints(
        sl.state_versions(rows, BLOCK), rows.select(*SCOPE, "seq").distinct(), BLOCK
    )


_CHANGES_SQL = (
    _VERSIONS_SQL
    + """,
changes AS (
  SELECT l.chat_id, l.branch_id, l.seq, l.path, v.value AS old_value, l.value AS new_value, l.op AS asked,
         v.path IS NOT NULL AS had, v.kind AS old_kind, l.kind AS new_kind
  FROM log l LEFT JOIN versions v ON v.chat_id = l.chat_id AND v.path = l.path AND v.valid_to = l.seq
)"""
)


@query(
    "state_deltas",
    _CHANGES_SQL
    + """
SELECT chat_id, branch_id, seq, path, split_part(path, '/', 2) AS section,
       CASE WHEN asked = 'remove' THEN 'remove' WHEN NOT had THEN 'add' ELSE 'replace' END AS op, old_value, new_value
FROM changes WHERE NOT (asked = 'remove' AND NOT had)
  AND NOT (asked <> 'remove' AND had AND old_kind = 'value' AND new_kind = 'value' AND old_value = new_value)""",
)
def state_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf)
    return sl.change_rows(rows, sl.state_versions(rows, BLOCK), BLOCK)


@query(
    "missing_removals",
    _CHANGES_SQL + " SELECT chat_id, branch_id, seq, path FROM changes WHERE asked = 'remove' AND NOT had",
)
def missing_removals(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf)
    return sl.missing_removals(rows, sl.state_versions(rows, BLOCK))


@query(
    "checkpoint_cadence",
    f"""
WITH {LOG_SQL},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq) AS n, seq % 97 = 5 AS forced FROM log
),
based AS (
  SELECT *, coalesce(max(CASE WHEN forced THEN n END) OVER (PARTITION BY chat_id ORDER BY seq), 0) AS base FROM numbered
)
SELECT chat_id, branch_id, seq AS message_index FROM based WHERE forced OR (n > base AND (n - base) % 20 = 0)""",
)
def checkpoint_cadence(spark: SparkSession, sf: str) -> DataFrame:
    chain = log(spark, sf).select(
        *SCOPE, F.col("seq").alias("message_index"), (F.col("seq") % 97 == 5).alias("forced")
    )
    return sl.checkpoint_marks(chain, 20, BLOCK).filter("checkpoint").select(*SCOPE, "message_index")


# Two versions of one document per event: the second edits, drops and adds members.
_DOC_SQL = """
WITH docs AS (
  SELECT event_id, event_type AS t, CAST(props->>'$.k' AS INTEGER) AS k FROM events
)"""


def _document_pairs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("t"), k.alias("k"))
    # before: {"a": {"k": K, "t": T}, "list": [K, 1]}
    before = F.concat(
        F.lit('{"list": ['), F.col("k").cast("string"), F.lit(', 1], "a": {"t": "'), "t",
        F.lit('", "k": '), F.col("k").cast("string"), F.lit("}}"),
    )
    # after: list kept; /a/k raised for even K; /a dropped for K % 5 = 0; /b~/c added for K % 3 = 0
    inner = F.concat(
        F.lit('"a": {"k": '),
        F.when(F.col("k") % 2 == 0, F.col("k") + 1).otherwise(F.col("k")).cast("string"),
        F.lit(', "t": "'), "t", F.lit('"}, '),
    )
    extra = F.when(F.col("k") % 3 == 0, F.lit('"b~/c": {"x": {"y": true}}, ')).otherwise("")
    after = F.concat(
        F.lit("{"),
        F.when(F.col("k") % 5 == 0, "").otherwise(inner),
        extra,
        F.lit('"list": ['), F.col("k").cast("string"), F.lit(",1]}"),
    )
    return rows.select("event_id", before.alias("before"), after.alias("after"))


def _documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = _document_pairs(spark, sf)
    return (
        sl.flatten_documents(docs, ["event_id"], "before", 4),
        sl.flatten_documents(docs, ["event_id"], "after", 4),
    )


_DIFF_SQL = (
    _DOC_SQL
    + """
SELECT event_id, 'remove' AS op, '/a' AS path, CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM docs WHERE k % 5 = 0
UNION ALL SELECT event_id, 'replace', '/a/k', CAST(k AS VARCHAR), CAST(k + 1 AS VARCHAR) FROM docs WHERE k % 5 <> 0 AND k % 2 = 0
UNION ALL SELECT event_id, 'add', '/b~0~1c', NULL, NULL FROM docs WHERE k % 3 = 0"""
)


@query("document_diff", _DIFF_SQL)
def document_diff(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _documents(spark, sf)
    return sl.diff_documents(before, after, ["event_id"]).select(
        "event_id", "op", "path", "old_value", "new_value"
    )


@query("document_diff_by_digests", _DIFF_SQL)
def document_diff_by_digests(spark: SparkSession, sf: str) -> DataFrame:
    changes = sl.diff_texts(_document_pairs(spark, sf), ["event_id"], "before", "after")
    return changes.select("event_id", "op", "path", "old_value", "new_value")


@query(
    "document_rows",
    _DOC_SQL
    + """
SELECT event_id, '' AS path, 'object' AS kind, CAST(NULL AS VARCHAR) AS value FROM docs
UNION ALL SELECT event_id, '/list', 'value', '[' || k || ',1]' FROM docs
UNION ALL SELECT event_id, '/a', 'object', NULL FROM docs
UNION ALL SELECT event_id, '/a/t', 'value', '"' || t || '"' FROM docs
UNION ALL SELECT event_id, '/a/k', 'value', CAST(k AS VARCHAR) FROM docs""",
)
def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf)[0]


@query(
    "canonical_json",
    "SELECT event_id, '{\"a\":' || CAST(props->>'$.k' AS INTEGER) || ',\"b\":[2,1]}' AS canonical FROM events",
)
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{ "b": [2, 1], "a": '), k, F.lit(" }"))
    return table(spark, sf, "events").select("event_id", sl.canonical_json(text).alias("canonical"))


@query(
    "snapshot_integrity",
    _VERSIONS_SQL
    + """
SELECT chat_id, branch_id, CASE WHEN CAST(chat_id AS BIGINT) % 4 = 1 THEN 'snapshot is missing'
  ELSE 'snapshot does not hash to its fingerprint' END AS reason
FROM (SELECT chat_id, branch_id, bool_or(valid_to IS NULL) AS alive FROM versions GROUP BY ALL
      UNION SELECT chat_id, branch_id, FALSE FROM log WHERE chat_id NOT IN (SELECT chat_id FROM versions))
WHERE CAST(chat_id AS BIGINT) % 4 = 3 OR (CAST(chat_id AS BIGINT) % 4 = 1 AND alive)""",
)
def snapshot_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of one scope in four are lost, of one in four tampered with. An empty state has
    no rows to lose."""
    rows = sl.latest_state(log(spark, sf))
    expected = sl.state_fingerprints(rows, SCOPE)
    everyone = log(spark, sf).select(*SCOPE).distinct().join(expected, SCOPE, "left")
    expected = everyone.fillna(sl.EMPTY_FINGERPRINT, ["state_fingerprint"])
    chat = F.col("chat_id").cast("bigint") % 4
    extra = log(spark, sf).filter(chat == 3).select(*SCOPE).distinct().select(
        *SCOPE, F.lit("/tampered").alias("path"), F.lit("value").alias("kind"), F.lit("1").alias("value")
    )
    kept = rows.filter(chat != 1).select(*SCOPE, "path", "kind", "value").unionByName(extra)
    return sl.verify_snapshots(expected, kept, SCOPE).select(*SCOPE, "reason")


# ---------------------------------------------------------------- stored checkpoints

#: Seqs of a partition of the stored tables here: the supplied logs span several.
_WIDTH = 1000


def _marks(rows: DataFrame) -> DataFrame:
    chain = rows.select(*SCOPE, F.col("seq").alias("message_index"), (F.col("seq") % 97 == 5).alias("forced"))
    return sl.checkpoint_marks(chain, 20, BLOCK).where("checkpoint").select(*SCOPE, F.col("message_index").alias("seq"))


def _checkpointed(spark: SparkSession, sf: str) -> str:
    """Root of the log and its checkpoints, written once per session: the first half of each
    chat's checkpoints from the whole log, the others from those."""

    def build(spark: SparkSession, sf: str) -> DataFrame:
        root = f"{scratch_dir(spark)}/checkpoints-{uuid.uuid4().hex}"
        rows = log(spark, sf)
        cp.append_log(rows, root, _WIDTH)
        marks = _marks(rows)
        middle = rows.agg(F.floor(F.avg("seq"))).first()[0] or 0
        early = F.col("seq") <= middle
        cp.write_checkpoints(rows.where(early), marks.where(early), root, _WIDTH, BLOCK)
        cp.extend_checkpoints(spark, root, marks.where(~early), _WIDTH, BLOCK)
        return spark.createDataFrame([(root,)], "root string")

    return kept(spark, sf, "checkpoint_root", build).first()["root"]


@query(
    "replay_from_checkpoint",
    _VERSIONS_SQL + " SELECT chat_id, branch_id, path, kind, value FROM versions WHERE valid_to IS NULL",
)
def replay_from_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """The newest state of every chat from its last checkpoint and the events after it."""
    ends = sl.last_seq(log(spark, sf)).select(*SCOPE, F.lit("end").alias("query_id"), F.col("last_seq").alias("at_seq"))
    return cp.replay_points(spark, _checkpointed(spark, sf), ends, _WIDTH, BLOCK).drop("query_id")


@query(
    "replay_every_floor",
    _VERSIONS_SQL
    + _POINTS_SQL
    + """
SELECT v.chat_id, p.query_id, v.path, v.kind, v.value FROM versions v
JOIN points p ON p.chat_id = v.chat_id AND v.valid_from <= p.at_seq AND (v.valid_to IS NULL OR v.valid_to > p.at_seq)""",
)
def replay_every_floor(spark: SparkSession, sf: str) -> DataFrame:
    rows = cp.replay_points(spark, _checkpointed(spark, sf), _every_seq(log(spark, sf)), _WIDTH, BLOCK)
    return rows.drop("branch_id")


@query(
    "checkpoint_integrity",
    f"""
WITH {LOG_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq) AS n, seq % 97 = 5 AS forced FROM log),
based AS (SELECT *, coalesce(max(CASE WHEN forced THEN n END) OVER (PARTITION BY chat_id ORDER BY seq), 0) AS base FROM numbered)
SELECT chat_id, branch_id, seq AS checkpoint_seq, 'checkpoint_mismatch' AS reason FROM based
WHERE (forced OR (n > base AND (n - base) % 20 = 0)) AND CAST(chat_id AS BIGINT) % 4 = 2""",
)
def checkpoint_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of one chat in four name other states than their checkpoints do."""
    rows = log(spark, sf)
    nodes = sl.node_fingerprints(sl.state_versions(rows, BLOCK), rows.select(*SCOPE, "seq").distinct(), BLOCK)
    other = F.concat("state_fingerprint", F.when(F.col("chat_id").cast("bigint") % 4 == 2, "x").otherwise(""))
    return cp.checkpoint_errors(spark, _checkpointed(spark, sf), nodes.withColumn("state_fingerprint", other))
