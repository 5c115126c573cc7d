"""Trusted prefixes, statuses, rebuild plans, reuse and drift."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.base import BLOCK, CHAIN_SQL, event_floors, kept, nodes, query
from turnledger.functions.keys import dependency_fingerprint, fingerprint
from turnledger.operators import chain as ch
from turnledger.operators.floors import SCOPE

_DEP = "'sha256:' || sha256({body} || chr(10) || {prev} || chr(10) || '1' || chr(10) || '1' || chr(10) || 'p1')"

# Walk both chains floor by floor; the newest node wins among equals.
PREFIX_SQL = f"""
WITH RECURSIVE {CHAIN_SQL},
pos AS (
  SELECT chat_id, branch_id, message_index, floor_id, body_fingerprint, status,
         row_number() OVER (PARTITION BY chat_id ORDER BY message_index) AS n
  FROM event_floors
),
by_dep AS (
  SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY floor_id, dependency_fingerprint ORDER BY created_at DESC, state_node_id DESC) = 1
),
by_link AS (
  SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY floor_id, coalesce(previous_state_fingerprint, '') ORDER BY created_at DESC, state_node_id DESC) = 1
),
strict AS (
  SELECT DISTINCT chat_id, CAST(0 AS BIGINT) AS n, '' AS fp, '' AS node FROM pos
  UNION ALL
  SELECT s.chat_id, p.n, d.state_fingerprint, d.state_node_id
  FROM strict s JOIN pos p ON p.chat_id = s.chat_id AND p.n = s.n + 1
  JOIN by_dep d ON d.floor_id = p.floor_id AND d.dependency_fingerprint = {_DEP.format(body="p.body_fingerprint", prev="s.fp")}
),
lineage AS (
  SELECT DISTINCT chat_id, CAST(0 AS BIGINT) AS n, '' AS fp, '' AS node FROM pos
  UNION ALL
  SELECT s.chat_id, p.n, d.state_fingerprint, d.state_node_id
  FROM lineage s JOIN pos p ON p.chat_id = s.chat_id AND p.n = s.n + 1
  JOIN by_link d ON d.floor_id = p.floor_id AND coalesce(d.previous_state_fingerprint, '') = s.fp
),
newest AS (
  SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY floor_id ORDER BY created_at DESC, state_node_id DESC) = 1
),
prefix AS (
  SELECT p.chat_id, p.branch_id, p.message_index, p.floor_id, p.n, p.status AS floor_status, p.body_fingerprint,
         coalesce(s.node, l.node, w.state_node_id) AS state_node_id,
         s.node IS NOT NULL AS valid, l.node IS NOT NULL AS lineage_valid,
         b.fp AS entry
  FROM pos p LEFT JOIN strict s ON s.chat_id = p.chat_id AND s.n = p.n
  LEFT JOIN lineage l ON l.chat_id = p.chat_id AND l.n = p.n
  LEFT JOIN strict b ON b.chat_id = p.chat_id AND b.n = p.n - 1
  LEFT JOIN newest w ON w.floor_id = p.floor_id
),
heads AS (
  SELECT chat_id, branch_id, count(*) AS floors,
         min(message_index) FILTER (NOT valid) AS first_invalid_index,
         min(message_index) FILTER (NOT lineage_valid) AS first_lineage_break_index,
         max_by(state_node_id, message_index) FILTER (valid) AS head,
         max_by(state_node_id, message_index) FILTER (lineage_valid) AS lineage_head
  FROM prefix GROUP BY ALL
)"""


def _walked(spark: SparkSession, sf: str) -> DataFrame:
    positions = event_floors(spark, sf).drop("user_id", "event_id", "content")
    return ch.trusted_prefix(positions, nodes(spark, sf), F.lit("p1"), BLOCK, 512, 2)


def _prefix(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "trusted_prefix", _walked)


@query(
    "trusted_prefix",
    PREFIX_SQL
    + " SELECT chat_id, branch_id, message_index, floor_id, state_node_id, valid, lineage_valid FROM prefix",
)
def trusted_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _walked(spark, sf).select(
        *SCOPE, "message_index", "floor_id", "state_node_id", "valid", "lineage_valid"
    )


@query("chain_heads", PREFIX_SQL + " SELECT * FROM heads")
def chain_heads(spark: SparkSession, sf: str) -> DataFrame:
    return ch.chain_heads(_prefix(spark, sf)).drop("head_fingerprint")


@query(
    "current_state_node",
    PREFIX_SQL
    + """
SELECT chat_id, branch_id, coalesce(lineage_head, CASE WHEN CAST(chat_id AS BIGINT) % 2 = 0 THEN 'stored' END) AS state_node_id,
       CASE WHEN lineage_head IS NOT NULL THEN 'chain' WHEN CAST(chat_id AS BIGINT) % 2 = 0 THEN 'head' ELSE 'empty' END AS source
FROM heads""",
)
def current_state_node(spark: SparkSession, sf: str) -> DataFrame:
    heads = (
        event_floors(spark, sf)
        .filter("user_id % 2 = 0")
        .select(*SCOPE, F.lit("stored").alias("state_node_id"))
        .distinct()
    )
    return ch.current_nodes(_prefix(spark, sf), heads)


@query(
    "resolve_previous_state",
    PREFIX_SQL
    + """
SELECT p.chat_id, p.message_index + 1 AS at_index, p.message_index AS previous_index,
       CASE WHEN p.valid THEN 'ready' ELSE 'blocked' END AS kind,
       CASE WHEN p.valid THEN p.state_node_id END AS previous_node_id,
       CASE WHEN NOT p.valid THEN CASE WHEN p.state_node_id IS NULL THEN 'it has no synced state node'
         WHEN p.lineage_valid THEN 'its state node was produced under a different prompt version'
         ELSE 'its state node no longer matches the chain before it' END END AS reason
FROM prefix p
UNION ALL SELECT chat_id, 0, NULL, 'start', NULL, NULL FROM heads""",
)
def resolve_previous_state(spark: SparkSession, sf: str) -> DataFrame:
    prefix = _prefix(spark, sf)
    points = event_floors(spark, sf).select(*SCOPE, (F.col("message_index") + 1).alias("at_index"))
    starts = points.select(*SCOPE).distinct().withColumn("at_index", F.lit(0).cast("long"))
    found = ch.resolve_previous(prefix, points.unionByName(starts), "at_index", BLOCK)
    return found.select("chat_id", "at_index", "previous_index", "kind", "previous_node_id", "reason")


@query(
    "node_status_refresh",
    PREFIX_SQL
    + """
SELECT n.chat_id, n.branch_id, n.state_node_id, n.status,
       CASE WHEN p.state_node_id IS NOT NULL THEN 'synced' ELSE 'stale' END AS new_status
FROM nodes n LEFT JOIN prefix p ON p.valid AND p.state_node_id = n.state_node_id
WHERE n.status <> CASE WHEN p.state_node_id IS NOT NULL THEN 'synced' ELSE 'stale' END""",
)
def node_status_refresh(spark: SparkSession, sf: str) -> DataFrame:
    made = nodes(spark, sf)
    return ch.node_status_updates(_prefix(spark, sf), made)


@query(
    "floor_status_refresh",
    PREFIX_SQL
    + """
SELECT chat_id, branch_id, floor_id, floor_status, CASE WHEN valid THEN 'synced' ELSE 'pending' END AS new_status
FROM prefix WHERE (valid AND floor_status <> 'synced') OR (NOT valid AND floor_status = 'synced')""",
)
def floor_status_refresh(spark: SparkSession, sf: str) -> DataFrame:
    return ch.floor_status_updates(_prefix(spark, sf))


@query(
    "state_at_floor",
    PREFIX_SQL
    + """
SELECT chat_id, message_index, floor_id, state_node_id, valid FROM prefix WHERE state_node_id IS NOT NULL
UNION ALL SELECT chat_id, message_index, NULL, NULL, NULL FROM prefix WHERE state_node_id IS NULL""",
)
def state_at_floor(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_floors(spark, sf)
    none = F.lit(None).cast("int").alias("swipe_id")
    located = rows.select(*SCOPE, "message_index", none, "floor_id", F.lit(1).alias("rank"))
    asked = rows.select(*SCOPE, "message_index", none)
    out = ch.state_at_floor(asked, located, _prefix(spark, sf), nodes(spark, sf))
    return out.select("chat_id", "message_index", "floor_id", "state_node_id", "valid")


# ---------------------------------------------------------------- results

# One result per node, some failed or still running, plus waiting work for a few floors.
RESULTS_SQL = """,
results AS (
  SELECT 'r' || state_node_id AS result_id, chat_id, branch_id, floor_id, message_index,
         CASE WHEN message_index % 31 = 0 THEN 'failed' WHEN message_index % 37 = 0 THEN 'running'
              WHEN message_index % 41 = 0 THEN 'pending' ELSE 'succeeded' END AS status,
         dependency_fingerprint, previous_state_fingerprint,
         CASE WHEN message_index % 62 = 0 THEN 'predecessor_pending' WHEN message_index % 31 = 0 THEN 'invalid_output' END AS error_code,
         CASE WHEN message_index % 43 <> 0 THEN '{}' END AS candidate, created_at, created_at + 5 AS finished_at
  FROM nodes
)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("message_index")
    return nodes(spark, sf).select(
        F.concat(F.lit("r"), "state_node_id").alias("result_id"),
        *SCOPE,
        "floor_id",
        "message_index",
        F.when(i % 31 == 0, "failed")
        .when(i % 37 == 0, "running")
        .when(i % 41 == 0, "pending")
        .otherwise("succeeded")
        .alias("status"),
        "dependency_fingerprint",
        "previous_state_fingerprint",
        F.when(i % 62 == 0, "predecessor_pending").when(i % 31 == 0, "invalid_output").alias("error_code"),
        F.when(i % 43 != 0, "{}").alias("candidate"),
        "created_at",
        (F.col("created_at") + 5).alias("finished_at"),
    )


_BROKEN_SQL = """,
flags AS (
  SELECT floor_id, bool_or(status IN ('pending', 'running')) AS in_flight,
         min_by(status, created_at) FILTER (status IN ('pending', 'running')) AS fly_status,
         min_by(coalesce(previous_state_fingerprint, ''), created_at) FILTER (status IN ('pending', 'running')) AS fly_prev,
         max_by(status, created_at) AS latest_status,
         max_by(coalesce(error_code, ''), created_at) AS latest_error
  FROM results GROUP BY floor_id
),
broken AS (
  SELECT p.*, f.in_flight, f.fly_status, f.fly_prev, f.latest_status, f.latest_error
  FROM prefix p JOIN heads h ON h.chat_id = p.chat_id AND h.first_invalid_index = p.message_index
  LEFT JOIN flags f ON f.floor_id = p.floor_id
)"""


@query(
    "scope_sync_status",
    PREFIX_SQL
    + RESULTS_SQL
    + _BROKEN_SQL
    + """
SELECT h.chat_id, h.first_invalid_index,
  CASE WHEN h.first_invalid_index IS NULL THEN 'synced' WHEN b.in_flight THEN 'pending'
       WHEN b.latest_status = 'failed' THEN 'failed' WHEN b.state_node_id IS NOT NULL THEN 'stale' ELSE 'missing' END AS sync_status
FROM heads h LEFT JOIN broken b ON b.chat_id = h.chat_id
UNION ALL SELECT 'empty:' || chat_id, NULL, 'empty' FROM heads""",
)
def scope_sync_status(spark: SparkSession, sf: str) -> DataFrame:
    known = event_floors(spark, sf).select(*SCOPE).distinct()
    empty = known.withColumn("chat_id", F.concat(F.lit("empty:"), "chat_id"))
    out = ch.sync_status(known.unionByName(empty), _prefix(spark, sf), results(spark, sf))
    return out.select("chat_id", "first_invalid_index", "sync_status")


def _plan_sql(auto: bool) -> str:
    rules = """
       WHEN state_node_id IS NOT NULL AND lineage_valid THEN 'prompt-version'
       WHEN NOT coalesce(in_flight, FALSE) AND latest_status = 'failed' AND latest_error <> 'predecessor_pending' THEN 'failed-floor'"""
    return (
        PREFIX_SQL
        + RESULTS_SQL
        + _BROKEN_SQL
        + f""",
marked AS (
  SELECT h.chat_id, h.first_invalid_index, b.floor_id, b.state_node_id, b.lineage_valid, b.in_flight, b.latest_status, b.latest_error,
         coalesce(b.in_flight AND (b.fly_status = 'pending' OR b.fly_prev = coalesce(b.entry, '')), FALSE) AS right_one,
         (SELECT count(*) FROM prefix p WHERE p.chat_id = h.chat_id AND p.message_index >= h.first_invalid_index) AS affected,
         (SELECT count(*) FROM results r WHERE r.chat_id = h.chat_id AND r.status = 'running' AND r.message_index > h.first_invalid_index) AS down
  FROM heads h LEFT JOIN broken b ON b.chat_id = h.chat_id
),
planned AS (
  SELECT *, CASE WHEN first_invalid_index IS NULL THEN 'chain-valid' WHEN right_one THEN 'already-queued' {rules if auto else ''}
       ELSE 'recompute' END AS outcome FROM marked
)
SELECT chat_id, first_invalid_index, outcome, CASE WHEN outcome IN ('recompute', 'already-queued') THEN floor_id END AS floor_id,
       affected, down + CASE WHEN coalesce(in_flight, FALSE) AND NOT right_one THEN 1 ELSE 0 END AS cancelled
FROM planned"""
    )


def _plan(mode: str, spark: SparkSession, sf: str) -> DataFrame:
    out = ch.rebuild_plan(_prefix(spark, sf), nodes(spark, sf), results(spark, sf), mode)
    return out.select("chat_id", "first_invalid_index", "outcome", "floor_id", "affected", "cancelled")


query("rebuild_plan_auto", _plan_sql(True))(functools.partial(_plan, "auto"))
query("rebuild_plan_manual", _plan_sql(False))(functools.partial(_plan, "manual"))

# Each scope forces a rebuild from its fifth floor; one in seven names a missing index.
_TARGETS_SQL = """,
targets AS (
  SELECT chat_id, CASE WHEN CAST(chat_id AS BIGINT) % 7 = 2 THEN -1 ELSE message_index END AS from_index FROM prefix WHERE n = 5
)"""


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    from turnledger.operators.skew import ordinal

    fifth = ordinal(event_floors(spark, sf), SCOPE, "message_index", "n", BLOCK).filter("n = 5")
    return fifth.select(
        *SCOPE,
        F.when(F.col("user_id") % 7 == 2, F.lit(-1)).otherwise(F.col("message_index")).alias("from_index"),
    )


@query(
    "forced_rebuild",
    PREFIX_SQL
    + _TARGETS_SQL
    + """
SELECT p.chat_id, t.from_index, p.message_index, p.floor_id, p.message_index = t.from_index AS recompute
FROM targets t JOIN heads h ON h.chat_id = t.chat_id JOIN prefix p ON p.chat_id = t.chat_id AND p.message_index >= t.from_index
WHERE t.from_index >= 0 AND (h.first_invalid_index IS NULL OR h.first_invalid_index >= t.from_index)""",
)
def forced_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = ch.forced_rebuild(_prefix(spark, sf), _targets(spark, sf))
    return good.select("chat_id", "from_index", "message_index", "floor_id", "recompute")


@query(
    "forced_rebuild_rejects",
    PREFIX_SQL
    + _TARGETS_SQL
    + """
SELECT t.chat_id, t.from_index, CASE WHEN t.from_index < 0 THEN 'no active floor at this index'
       ELSE 'the chain is already invalid before it' END AS reason
FROM targets t JOIN heads h ON h.chat_id = t.chat_id WHERE t.from_index < 0 OR h.first_invalid_index < t.from_index""",
)
def forced_rebuild_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = ch.forced_rebuild(_prefix(spark, sf), _targets(spark, sf))
    return bad.select("chat_id", "from_index", "reason")


@query(
    "reuse_decision",
    PREFIX_SQL
    + RESULTS_SQL
    + f""",
wanted AS (SELECT *, {_DEP.format(body="body_fingerprint", prev="entry")} AS dep FROM prefix WHERE entry IS NOT NULL),
kept AS (SELECT * FROM results WHERE status = 'succeeded' AND candidate IS NOT NULL),
own AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY floor_id, dependency_fingerprint ORDER BY finished_at DESC, created_at DESC, result_id DESC) = 1),
other AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY branch_id, dependency_fingerprint ORDER BY finished_at DESC, created_at DESC, result_id DESC) = 1)
SELECT w.chat_id, w.message_index, w.floor_id,
       CASE WHEN w.valid AND w.message_index % 2 = 0 THEN 'reuse-node'
            WHEN o.result_id IS NOT NULL OR b.result_id IS NOT NULL THEN 'reapply' ELSE 'recompute' END AS outcome,
       CASE WHEN NOT (w.valid AND w.message_index % 2 = 0) THEN coalesce(o.result_id, b.result_id) END AS result_id
FROM wanted w LEFT JOIN own o ON o.floor_id = w.floor_id AND o.dependency_fingerprint = w.dep
LEFT JOIN other b ON b.branch_id = w.branch_id AND b.dependency_fingerprint = w.dep""",
)
def reuse_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Every other valid node is treated as lost, so its stored result is applied again."""
    rows = _prefix(spark, sf)
    lost = rows.withColumn("valid", F.col("valid") & (F.col("message_index") % 2 == 0))
    return ch.reuse_decisions(lost, results(spark, sf)).drop("branch_id")


@query(
    "prior_result_lookup",
    f"""
WITH {CHAIN_SQL}{RESULTS_SQL}
SELECT floor_id, result_id FROM results WHERE status = 'succeeded' AND candidate IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY floor_id ORDER BY finished_at DESC, created_at DESC, result_id DESC) = 1""",
)
def prior_result_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return ch.prior_results(results(spark, sf), ["floor_id"], []).select("floor_id", "result_id")


@query(
    "result_listing",
    f"""
WITH {CHAIN_SQL}{RESULTS_SQL}
SELECT result_id, message_index, status FROM results
WHERE chat_id = (SELECT min(chat_id) FROM results) AND status = 'succeeded'
ORDER BY message_index, created_at""",
)
def result_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = results(spark, sf)
    smallest = rows.agg(F.min("chat_id").alias("chat_id"))
    one = rows.join(smallest, "chat_id", "left_semi").withColumn("chat_id", F.lit("first"))
    return ch.list_results(one, "first", status="succeeded").select(
        "result_id", "message_index", "status"
    )


@query(
    "drift_check",
    f"""
WITH {CHAIN_SQL}
SELECT floor_id, CASE WHEN event_id % 10 = 0 THEN 'floor changed during analysis'
  WHEN event_id % 10 = 1 THEN 'floor is no longer the active variant'
  WHEN event_id % 10 = 2 THEN 'previous state is no longer available'
  WHEN event_id % 10 = 3 THEN 'state prompt changed during analysis'
  WHEN event_id % 10 = 4 THEN 'previous effective state changed during analysis' END AS cause
FROM linked""",
)
def drift_check(spark: SparkSession, sf: str) -> DataFrame:
    from turnledger.operators.skew import previous_row

    made = event_floors(spark, sf).withColumn(
        "fp", fingerprint(F.concat(F.lit("state:"), F.col("event_id").cast("string")))
    )
    linked = previous_row(made, SCOPE, "message_index", {"before": "fp"}, BLOCK)
    case = F.col("event_id") % 10
    body, before = F.col("body_fingerprint"), F.col("before")
    old = linked.select(
        *SCOPE,
        "floor_id",
        F.when(case == 0, F.lit("sha256:old")).otherwise(body).alias("body_fingerprint"),
        F.when(case == 3, "p0").otherwise("p1").alias("prompt_version"),
        F.when(case == 4, F.lit("sha256:other")).otherwise(before).alias("previous_state_fingerprint"),
    ).withColumn(
        "dependency_fingerprint",
        dependency_fingerprint(
            F.col("body_fingerprint"), F.col("previous_state_fingerprint"), F.col("prompt_version")
        ),
    )
    variants = linked.select("floor_id", "body_fingerprint", (case != 1).alias("active"))
    now = linked.select(
        "floor_id",
        F.when(case == 2, "blocked").otherwise("ready").alias("kind"),
        before.alias("previous_fingerprint"),
        F.lit("p1").alias("prompt_version"),
        dependency_fingerprint(body, before, F.lit("p1")).alias("dependency_fingerprint"),
    )
    return ch.drift_check(old, variants, now).select("floor_id", "cause")


@query(
    "state_node_scan",
    f"""
WITH {CHAIN_SQL}
SELECT floor_id, state_node_id, row_number() OVER (PARTITION BY floor_id ORDER BY created_at DESC, state_node_id DESC) AS rank FROM nodes""",
)
def state_node_scan(spark: SparkSession, sf: str) -> DataFrame:
    return ch.nodes_of_floor(nodes(spark, sf)).select("floor_id", "state_node_id", "rank")


@query(
    "state_node_counts",
    f"WITH {CHAIN_SQL} SELECT chat_id, branch_id, count(*) AS nodes FROM nodes GROUP BY ALL",
)
def state_node_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ch.node_counts(nodes(spark, sf))


@query(
    "state_node_listing",
    f"WITH {CHAIN_SQL} SELECT chat_id, branch_id, message_index, created_at, state_node_id, floor_id FROM nodes",
)
def state_node_listing(spark: SparkSession, sf: str) -> DataFrame:
    return ch.list_nodes(nodes(spark, sf))
