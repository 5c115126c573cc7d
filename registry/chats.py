"""Floors, reconcile, branches, the recent window and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.base import (
    BLOCK,
    FLOORS_SQL,
    INCOMING_SQL,
    REQUESTS_SQL,
    STORED_SQL,
    floors,
    incoming,
    query,
    requests,
    stored,
    table,
)
from registry.retrieval import _RERANK_SQL, _final
from registry.base import memories, searches
from turnledger.functions.keys import (
    dependency_fingerprint,
    fingerprint,
    join_pointer,
    split_pointer,
)
from turnledger.operators import branches as br
from turnledger.operators import floors as fl
from turnledger.operators import pack as pk
from turnledger.operators.bm25 import staged
from turnledger.operators.floors import SCOPE

NOW = "2026-02-01 00:00:00"


def _now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


# ---------------------------------------------------------------- keys


@query(
    "body_fingerprints",
    "SELECT conv_id, turn, 'sha256:' || sha256(text) AS fingerprint FROM conversations",
)
def body_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", fingerprint(F.col("text")).alias("fingerprint")
    )


@query(
    "dependency_fingerprints",
    """
SELECT conv_id, turn, 'sha256:' || sha256('sha256:' || sha256(text) || chr(10)
  || CASE WHEN turn % 2 = 0 THEN '' ELSE role END || chr(10) || '1' || chr(10) || '1' || chr(10) || 'p' || turn) AS dependency
FROM conversations""",
)
def dependency_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    prompt = F.concat(F.lit("p"), F.col("turn").cast("string"))
    previous = F.when(F.col("turn") % 2 != 0, F.col("role"))
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        dependency_fingerprint(fingerprint(F.col("text")), previous, prompt).alias("dependency"),
    )


@query(
    "json_pointers",
    """
SELECT page_id, '/pages/' || replace(replace(url, '~', '~0'), '/', '~1') AS pointer, 2 AS depth, url AS last_segment
FROM pages""",
)
def json_pointers(spark: SparkSession, sf: str) -> DataFrame:
    pointer = join_pointer(F.array(F.lit("pages"), F.col("url")))
    return (
        table(spark, sf, "pages")
        .select("page_id", pointer.alias("pointer"))
        .withColumn("_s", split_pointer(F.col("pointer")))
        .select("page_id", "pointer", F.size("_s").alias("depth"), F.element_at("_s", -1).alias("last_segment"))
    )


# ---------------------------------------------------------------- floors

_RAW_SQL = """
WITH raw AS (
  SELECT CAST(conv_id AS VARCHAR) AS chat_id, 'main:' || conv_id AS branch_id, turn - 1 AS message_index,
         CASE WHEN turn % 6 = 5 THEN -1 END AS swipe_id,
         CASE WHEN conv_id % 12 = 4 THEN '' ELSE text END AS content
  FROM conversations
),
marked AS (
  SELECT *, CASE WHEN message_index < 0 THEN 'message_index' WHEN swipe_id < 0 THEN 'swipe_id'
                 WHEN content IS NULL OR content = '' THEN 'content is required' END AS reason
  FROM raw
)"""


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    chat = F.col("conv_id").cast("string")
    return table(spark, sf, "conversations").select(
        chat.alias("chat_id"),
        F.concat(F.lit("main:"), chat).alias("branch_id"),
        (F.col("turn") - 1).alias("message_index"),
        F.when(F.col("turn") % 6 == 5, F.lit(-1)).alias("swipe_id"),
        F.when(F.col("conv_id") % 12 == 4, "").otherwise(F.col("text")).alias("content"),
    )


@query(
    "incoming_floors_scan",
    _RAW_SQL
    + """
SELECT chat_id, message_index, branch_id || ':' || chat_id || ':' || message_index || ':' || coalesce(swipe_id, 0)
       || ':sha256:' || sha256(content) AS floor_id
FROM marked WHERE reason IS NULL""",
)
def incoming_floors_scan(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = fl.split_incoming(_raw(spark, sf))
    return fl.with_keys(good).select("chat_id", "message_index", "floor_id")


@query(
    "incoming_floor_rejects",
    _RAW_SQL + " SELECT chat_id, message_index, reason FROM marked WHERE reason IS NOT NULL",
)
def incoming_floor_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = fl.split_incoming(_raw(spark, sf))
    return bad.select("chat_id", "message_index", "reason")


@query(
    "duplicate_locators",
    f"""
WITH {FLOORS_SQL},
given AS (
  SELECT chat_id, branch_id, message_index, swipe_id FROM floors
  UNION ALL SELECT chat_id, branch_id, message_index, 0 FROM floors WHERE CAST(chat_id AS BIGINT) % 8 = 3
)
SELECT chat_id, branch_id, message_index, coalesce(swipe_id, 0) AS swipe_id, count(*) AS copies
FROM given GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_locators(spark: SparkSession, sf: str) -> DataFrame:
    base = floors(spark, sf)
    again = base.filter("cast(chat_id as bigint) % 8 = 3").withColumn("swipe_id", F.lit(0))
    return fl.duplicate_locators(base.unionByName(again))


@query(
    "requests_without_duplicates",
    f"""
WITH {FLOORS_SQL}
SELECT chat_id, message_index FROM floors WHERE CAST(chat_id AS BIGINT) % 8 <> 3""",
)
def requests_without_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    base = floors(spark, sf)
    again = base.filter("cast(chat_id as bigint) % 8 = 3").withColumn("swipe_id", F.lit(0))
    clean, _ = fl.reject_duplicate_requests(base.unionByName(again))
    return clean.select("chat_id", "message_index")


@query(
    "floor_upsert",
    f"""
WITH {STORED_SQL}
SELECT floor_id, active, CASE WHEN CAST(chat_id AS BIGINT) % 5 = 1 THEN 'failed' ELSE status END AS status,
       CASE WHEN CAST(chat_id AS BIGINT) % 5 = 1 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at, created_at
FROM stored WHERE NOT (CAST(chat_id AS BIGINT) % 5 = 0)
UNION ALL
SELECT floor_id, TRUE, status, TIMESTAMP '{NOW}', created_at FROM stored WHERE CAST(chat_id AS BIGINT) % 5 = 0""",
)
def floor_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """One chat in five is new, one in five is written again twice with another status."""
    every = stored(spark, sf)
    chat = F.col("chat_id").cast("bigint") % 5
    new = every.filter(chat == 0).withColumn("updated_at", _now())
    again = every.filter(chat == 1)
    first = again.withColumn("status", F.lit("pending")).withColumn(
        "updated_at", F.lit("2026-01-15").cast("timestamp")
    )
    last = again.withColumn("status", F.lit("failed")).withColumn("updated_at", _now())
    fresh = new.unionByName(first).unionByName(last)
    out = fl.upsert_floors(every.filter(chat != 0), fresh)
    return out.select("floor_id", "active", "status", "updated_at", "created_at")


@query(
    "active_floor_scan",
    f"""
WITH {STORED_SQL}
SELECT chat_id, message_index, floor_id, status,
       row_number() OVER (PARTITION BY chat_id ORDER BY message_index) AS position
FROM stored WHERE active""",
)
def active_floor_scan(spark: SparkSession, sf: str) -> DataFrame:
    from turnledger.operators.skew import ordinal

    every = stored(spark, sf)
    active = every.filter("active").select(*SCOPE, "message_index", "floor_id")
    rows = fl.active_floors(every, active)
    return ordinal(rows, SCOPE, "message_index", "position", BLOCK).select(
        "chat_id", "message_index", "floor_id", "status", "position"
    )


@query(
    "locator_lookup",
    f"""
WITH {STORED_SQL},
wanted AS (SELECT DISTINCT chat_id, message_index FROM floors)
SELECT s.chat_id, s.message_index, s.floor_id,
       row_number() OVER (PARTITION BY s.chat_id, s.message_index, coalesce(s.swipe_id, 0)
         ORDER BY s.active DESC, s.updated_at DESC, s.floor_id) AS rank
FROM stored s JOIN wanted w ON w.chat_id = s.chat_id AND w.message_index = s.message_index
WHERE coalesce(s.swipe_id, 0) = 1 OR CAST(s.chat_id AS BIGINT) % 2 = 0""",
)
def locator_lookup(spark: SparkSession, sf: str) -> DataFrame:
    every = stored(spark, sf)
    base = floors(spark, sf).select(*SCOPE, "message_index")
    asked = base.withColumn("swipe_id", F.lit(1)).unionByName(
        base.filter("cast(chat_id as bigint) % 2 = 0").withColumn("swipe_id", F.lit(None).cast("int"))
    )
    return fl.locate(every, asked).select("chat_id", "message_index", "floor_id", "rank")


# ---------------------------------------------------------------- reconcile

_RECONCILE_SQL = f"""
WITH {STORED_SQL},
{INCOMING_SQL},
keyed AS (
  SELECT *, branch_id || ':' || chat_id || ':' || message_index || ':' || coalesce(swipe_id, 0) || ':sha256:' || sha256(content) AS floor_id
  FROM incoming
),
scopes AS (SELECT DISTINCT chat_id FROM keyed),
new AS (SELECT k.* FROM keyed k LEFT JOIN stored s ON s.floor_id = k.floor_id WHERE s.floor_id IS NULL),
out AS (
  SELECT s.floor_id, s.chat_id, s.message_index, s.active AS was, s.status AS old_status,
    CASE WHEN k.floor_id IS NOT NULL THEN 'reused'
         WHEN s.chat_id NOT IN (SELECT chat_id FROM scopes) THEN 'untouched'
         WHEN NOT EXISTS (SELECT 1 FROM keyed x WHERE x.chat_id = s.chat_id AND x.message_index = s.message_index) THEN 'removed'
         WHEN s.active AND EXISTS (SELECT 1 FROM new x WHERE x.chat_id = s.chat_id AND x.message_index = s.message_index
                                   AND coalesce(x.swipe_id, 0) = coalesce(s.swipe_id, 0)) THEN 'replaced'
         ELSE 'inactive' END AS outcome
  FROM stored s LEFT JOIN keyed k ON k.floor_id = s.floor_id
  UNION ALL
  SELECT floor_id, chat_id, message_index, NULL, NULL, 'created' FROM new
),
reconciled AS (
  SELECT floor_id, chat_id, message_index, outcome,
    CASE WHEN outcome = 'untouched' THEN was ELSE outcome IN ('reused', 'created') END AS active,
    CASE WHEN outcome = 'created' OR (outcome = 'reused' AND old_status = 'stale') THEN 'pending'
         WHEN outcome IN ('replaced', 'removed') THEN 'stale' ELSE old_status END AS status
  FROM out
)"""


def _reconciled(spark: SparkSession, sf: str) -> DataFrame:
    return fl.reconcile(stored(spark, sf), incoming(spark, sf), _now())


@query("chat_reconcile", _RECONCILE_SQL + " SELECT * FROM reconciled")
def chat_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return _reconciled(spark, sf).select(
        "floor_id", "chat_id", "message_index", "outcome", "active", "status"
    )


@query(
    "reconcile_result_lists",
    _RECONCILE_SQL
    + """
SELECT chat_id, 'main:' || chat_id AS branch_id, count(*) FILTER (active) AS active,
       count(*) FILTER (outcome = 'reused') AS reused, count(*) FILTER (outcome = 'created') AS created,
       count(*) FILTER (outcome IN ('replaced', 'removed')) AS stale
FROM reconciled GROUP BY chat_id""",
)
def reconcile_result_lists(spark: SparkSession, sf: str) -> DataFrame:
    return fl.reconcile_counts(_reconciled(spark, sf))


@query(
    "active_set_replace",
    _RECONCILE_SQL + " SELECT chat_id, message_index, floor_id FROM reconciled WHERE active",
)
def active_set_replace(spark: SparkSession, sf: str) -> DataFrame:
    before = stored(spark, sf).filter("active")
    return fl.replace_active_set(before, _reconciled(spark, sf)).select(
        "chat_id", "message_index", "floor_id"
    )


# ---------------------------------------------------------------- branches

# Each chat is forked at its floor with index 3; one chat in six names a foreign floor.
_FORK_SQL = f"""
WITH {STORED_SQL},
forks AS (
  SELECT f.chat_id, f.branch_id AS source_branch_id, 'fork:' || f.chat_id AS branch_id,
         CASE WHEN CAST(f.chat_id AS BIGINT) % 6 = 1 THEN 'foreign' ELSE f.floor_id END AS fork_floor_id, f.message_index
  FROM floors f WHERE f.message_index = 3
)"""


def _forks(spark: SparkSession, sf: str) -> DataFrame:
    return (
        floors(spark, sf)
        .filter("message_index = 3")
        .select(
            "chat_id",
            F.col("branch_id").alias("source_branch_id"),
            F.concat(F.lit("fork:"), "chat_id").alias("branch_id"),
            F.when(F.col("chat_id").cast("bigint") % 6 == 1, "foreign")
            .otherwise(F.col("floor_id"))
            .alias("fork_floor_id"),
        )
    )


@query(
    "branch_fork",
    _FORK_SQL
    + """
SELECT s.chat_id, k.branch_id, s.message_index, s.active, s.status,
       k.branch_id || ':' || s.chat_id || ':' || s.message_index || ':' || coalesce(s.swipe_id, 0) || ':' || s.body_fingerprint AS floor_id
FROM stored s JOIN forks k ON k.chat_id = s.chat_id AND s.message_index <= k.message_index AND k.fork_floor_id <> 'foreign'""",
)
def branch_fork(spark: SparkSession, sf: str) -> DataFrame:
    every = stored(spark, sf)
    valid, _ = br.check_forks(_forks(spark, sf), every)
    return br.fork_variants(valid, every).select(
        "chat_id", "branch_id", "message_index", "active", "status", "floor_id"
    )


@query(
    "branch_fork_active_set",
    _FORK_SQL
    + """
SELECT s.chat_id, k.branch_id, s.message_index,
       k.branch_id || ':' || s.chat_id || ':' || s.message_index || ':' || coalesce(s.swipe_id, 0) || ':' || s.body_fingerprint AS floor_id
FROM stored s JOIN forks k ON k.chat_id = s.chat_id AND s.message_index <= k.message_index AND k.fork_floor_id <> 'foreign'
WHERE s.active""",
)
def branch_fork_active_set(spark: SparkSession, sf: str) -> DataFrame:
    every = stored(spark, sf)
    valid, _ = br.check_forks(_forks(spark, sf), every)
    return br.fork_active_set(valid, every.filter("active"), every)


@query(
    "branch_fork_rejects",
    _FORK_SQL + " SELECT chat_id, fork_floor_id FROM forks WHERE fork_floor_id = 'foreign'",
)
def branch_fork_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, rejects = br.check_forks(_forks(spark, sf), stored(spark, sf))
    return rejects.select("chat_id", "fork_floor_id")


_BRANCHES_SQL = f"""
WITH {FLOORS_SQL},
chats AS (SELECT DISTINCT chat_id FROM floors),
branches AS (
  SELECT chat_id, 'main:' || chat_id AS branch_id, TRUE AS active FROM chats
  UNION ALL SELECT chat_id, 'fork:' || chat_id, FALSE FROM chats WHERE CAST(chat_id AS BIGINT) % 2 = 0
)"""


def _branches(spark: SparkSession, sf: str) -> DataFrame:
    chats = floors(spark, sf).select("chat_id").distinct()
    main = chats.select(
        "chat_id", F.concat(F.lit("main:"), "chat_id").alias("branch_id"), F.lit(True).alias("active")
    )
    fork = chats.filter("cast(chat_id as bigint) % 2 = 0").select(
        "chat_id", F.concat(F.lit("fork:"), "chat_id").alias("branch_id"), F.lit(False).alias("active")
    )
    return main.unionByName(fork)


@query(
    "branch_activate",
    _BRANCHES_SQL
    + """
SELECT chat_id, branch_id,
       CASE WHEN CAST(chat_id AS BIGINT) % 6 = 0 THEN branch_id LIKE 'fork:%' ELSE active END AS active
FROM branches""",
)
def branch_activate(spark: SparkSession, sf: str) -> DataFrame:
    """Chats divisible by three ask for their fork; only even ones have one."""
    every = _branches(spark, sf)
    asked = every.filter("active and cast(chat_id as bigint) % 3 = 0").select(
        "chat_id", F.concat(F.lit("fork:"), "chat_id").alias("branch_id")
    )
    updated, _ = br.activate_branches(every, asked)
    return updated


@query(
    "default_branch",
    f"""
WITH {REQUESTS_SQL}
SELECT query_id, CASE WHEN user_index % 4 = 0 THEN 'named' WHEN CAST(chat_id AS BIGINT) % 3 = 0 THEN 'fork:' || chat_id
                      ELSE 'main:' || chat_id END AS branch_id
FROM requests""",
)
def default_branch(spark: SparkSession, sf: str) -> DataFrame:
    asked = requests(spark, sf).withColumn(
        "branch_id", F.when(F.col("user_index") % 4 == 0, "named")
    )
    chats = (
        asked.select("chat_id")
        .distinct()
        .filter("cast(chat_id as bigint) % 6 <> 2")
        .withColumn(
            "active_branch_id",
            F.when(F.col("chat_id").cast("bigint") % 3 == 0, F.concat(F.lit("fork:"), "chat_id")),
        )
    )
    return br.resolve_branches(asked, chats).select("query_id", "branch_id")


@query(
    "host_chat_bind",
    f"""
WITH {FLOORS_SQL},
asked AS (
  SELECT chat_id, message_index, floor_id, CAST(chat_id AS BIGINT) AS n FROM floors
)
SELECT 'host:' || chat_id || ':' || message_index AS host_chat_id,
  CASE WHEN n % 9 = 0 THEN 'already_bound' WHEN n % 5 = 0 THEN 'root' WHEN n % 5 = 1 THEN 'fork_missing'
       WHEN n % 5 = 2 THEN 'fork_not_in_parent' ELSE 'forked' END AS outcome,
  CASE WHEN n % 9 = 0 THEN 'bound:' || chat_id WHEN n % 5 = 0 THEN 'main:host:' || chat_id || ':' || message_index
       WHEN n % 5 IN (3, 4) THEN 'new:' || chat_id || ':' || message_index END AS branch_id,
  CASE WHEN n % 9 <> 0 AND n % 5 IN (3, 4) THEN 'main:' || chat_id END AS parent_branch_id,
  CASE WHEN n % 9 <> 0 AND n % 5 IN (3, 4) THEN floor_id END AS fork_floor_id
FROM asked""",
)
def host_chat_bind(spark: SparkSession, sf: str) -> DataFrame:
    base = floors(spark, sf)
    n = F.col("chat_id").cast("bigint")
    tail = F.concat_ws(":", "chat_id", F.col("message_index").cast("string"))
    asked = base.select(
        F.concat(F.lit("host:"), tail).alias("host_chat_id"),
        F.when(n % 5 != 0, F.col("chat_id")).alias("main_chat_id"),
        F.when(n % 5 != 1, F.col("message_index")).alias("fork_index"),
        # A swipe number never equals a missing one.
        F.when(n % 5 == 2, F.lit(0)).alias("fork_swipe_id"),
        F.col("content").alias("fork_content"),
        F.concat(F.lit("new:"), tail).alias("new_branch_id"),
    )
    bound = base.filter(n % 9 == 0).select(
        F.concat(F.lit("host:"), tail).alias("host_chat_id"),
        F.concat(F.lit("bound:"), "chat_id").alias("branch_id"),
    )
    chats = base.select("chat_id", F.lit(None).cast("string").alias("active_branch_id")).distinct()
    return br.bind_host_chats(asked, bound, chats, floors(spark, sf)).drop("main_chat_id")


# ---------------------------------------------------------------- recent window, packing

_WINDOW_SQL = f"""
WITH {FLOORS_SQL},
{REQUESTS_SQL},
recent AS (
  SELECT r.chat_id, r.query_id, r.user_text, f.message_index, f.content,
         row_number() OVER (PARTITION BY r.query_id ORDER BY f.message_index DESC) AS slot
  FROM requests r JOIN floors f ON f.chat_id = r.chat_id AND f.message_index < r.user_index
  QUALIFY slot <= 2
)"""


def _window(spark: SparkSession, sf: str) -> DataFrame:
    return pk.recent_window(requests(spark, sf), floors(spark, sf), 2, BLOCK)


@query(
    "recent_window",
    _WINDOW_SQL + " SELECT chat_id, query_id, message_index, slot FROM recent",
)
def recent_window(spark: SparkSession, sf: str) -> DataFrame:
    return _window(spark, sf).select("chat_id", "query_id", "message_index", "slot")


_PATTERN = r"(zzz)?\b(the [a-z]+)"


@query(
    "recent_context_summary",
    _WINDOW_SQL
    + r"""
SELECT query_id, message_index,
       CASE WHEN regexp_matches(content, '\b(the [a-z]+)') THEN regexp_extract(content, '\b(the [a-z]+)', 1) ELSE content END AS text,
       CASE WHEN regexp_matches(content, '\b(the [a-z]+)') THEN 'summary' ELSE 'fallback' END AS source
FROM recent""",
)
def recent_context_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The first group never takes part, so the second, non-blank one is the summary."""
    rows = pk.recent_context(_window(spark, sf), "summary", _PATTERN)
    return rows.select("query_id", "message_index", "text", "source")


@query(
    "recall_query_text",
    _WINDOW_SQL
    + """
, texts AS (SELECT query_id, string_agg(content, chr(10) ORDER BY slot DESC) AS t FROM recent GROUP BY query_id)
SELECT r.query_id, sha256(CASE WHEN t IS NULL THEN user_text ELSE user_text || chr(10) || t END) AS text_key
FROM requests r LEFT JOIN texts USING (query_id)""",
)
def recall_query_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = pk.recall_query(requests(spark, sf), pk.recent_context(_window(spark, sf)))
    return rows.select("query_id", F.sha2("text", 256).alias("text_key"))


@query(
    "token_budget",
    """
SELECT doc_id, greatest(2000.0, least(greatest(n_chars, 0) * 20 * 0.03, 6000.0)) AS budget FROM documents""",
)
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.round(pk.token_budget(F.col("n_chars") * 20), 6).alias("budget")
    )


_FIXED_SQL = """
fixed AS (
  SELECT chat_id, branch_id, memory_id,
         row_number() OVER (PARTITION BY chat_id, branch_id ORDER BY end_floor DESC, start_floor DESC, memory_id) AS rank
  FROM memories WHERE NOT stale QUALIFY rank <= 2
)"""


@query("fixed_recent", _RERANK_SQL + "," + _FIXED_SQL + " SELECT * FROM fixed")
def fixed_recent(spark: SparkSession, sf: str) -> DataFrame:
    return pk.fixed_recent(memories(spark, sf)).select(*SCOPE, "memory_id", "rank")


_CAND_SQL = (
    _RERANK_SQL
    + ","
    + _FIXED_SQL
    + """,
asked AS (SELECT DISTINCT chat_id, branch_id, query_id FROM searches),
both_lists AS (
  SELECT a.chat_id, a.branch_id, a.query_id, f.memory_id, 0 AS p, f.rank FROM asked a JOIN fixed f ON f.branch_id = a.branch_id
  UNION ALL SELECT chat_id, branch_id, query_id, memory_id, 1, rank FROM final
),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY branch_id, query_id, memory_id ORDER BY p, rank) AS copy
  FROM both_lists QUALIFY copy = 1
),
candidates AS (
  SELECT chat_id, branch_id, query_id, memory_id, CASE WHEN p = 0 THEN 'fixed_recent' ELSE 'high_relevance' END AS source,
         row_number() OVER (PARTITION BY branch_id, query_id ORDER BY p, rank) AS ord
  FROM firsts
)"""
)


def _candidates(spark: SparkSession, sf: str, counts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    final = _final(spark, sf)
    asked = searches(spark, sf).select(*pk.QUERY).distinct()
    newest = pk.fixed_recent(memories(spark, sf)).select(*SCOPE, "memory_id", "rank")
    fixed = asked.join(newest, SCOPE)
    return pk.merge_candidates(fixed, final, counts), fixed, final


@query("priority_dedupe", _CAND_SQL + " SELECT * FROM candidates")
def priority_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf)[0]


_OPTIONS = pk.PackOptions(max_count=5, fixed_count=2, token_limit=700)
_HEADER_SQL = "'" + _OPTIONS.header.replace("\n", "' || chr(10) || '") + "'"
_CJK = r"'[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g'"
_PACK_SQL = (
    _CAND_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + rf""",
blocks AS (
  SELECT c.*, m.start_floor, m.end_floor,
    '[记忆 ' || m.start_floor || '-' || m.end_floor || ']' || chr(10)
      || CASE WHEN trim(coalesce(m.title, '')) <> '' THEN trim(m.title) || chr(10) ELSE '' END
      || trim(m.summary, chr(9) || chr(10) || chr(13) || ' ') AS block
  FROM candidates c JOIN memories m ON m.memory_id = c.memory_id
),
sized AS (
  SELECT *, length(regexp_replace(block, {_CJK})) AS cjk, length(block) - length(regexp_replace(block, {_CJK})) AS other
  FROM blocks
),
walk AS (
  SELECT branch_id, query_id, 0 AS ord, 0 AS n, length(regexp_replace({_HEADER_SQL}, {_CJK})) AS cjk,
         length({_HEADER_SQL}) - length(regexp_replace({_HEADER_SQL}, {_CJK})) AS other,
         CAST([] AS BIGINT[]) AS taken, 0 AS over_budget, 0 AS over_count
  FROM (SELECT DISTINCT branch_id, query_id FROM sized)
  UNION ALL
  SELECT branch_id, query_id, ord, n + take, CASE WHEN take = 1 THEN cjk2 ELSE cjk END, CASE WHEN take = 1 THEN other2 ELSE other END,
         CASE WHEN take = 1 THEN list_append(taken, ord) ELSE taken END,
         over_budget + CASE WHEN take = 0 AND n < 5 THEN 1 ELSE 0 END, over_count + CASE WHEN n >= 5 THEN 1 ELSE 0 END
  FROM (
    SELECT w.branch_id, w.query_id, s.ord, w.n, w.cjk, w.other, w.taken, w.over_budget, w.over_count,
           w.cjk + s.cjk AS cjk2, w.other + s.other + CASE WHEN w.n > 0 THEN 2 ELSE 0 END AS other2,
           CASE WHEN w.n < 5 AND w.cjk + s.cjk + ceil((w.other + s.other + CASE WHEN w.n > 0 THEN 2 ELSE 0 END) / 4.0) <= 700
                THEN 1 ELSE 0 END AS take
    FROM walk w JOIN sized s ON s.branch_id = w.branch_id AND s.query_id = w.query_id AND s.ord = w.ord + 1
  )
),
packed AS (
  SELECT *, row_number() OVER (PARTITION BY branch_id, query_id ORDER BY ord DESC) AS last FROM walk QUALIFY last = 1
)"""
)


def _packed(spark: SparkSession, sf: str, counts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    candidates, fixed, final = _candidates(spark, sf, counts)
    # Written, a few rows a query: the planner sees that texts need not be shuffled to meet them.
    candidates = staged(candidates, "candidates")
    detail = memories(spark, sf).select(
        *SCOPE, "memory_id", "start_floor", "end_floor", "title", "summary"
    )
    rows = candidates.join(detail, [*SCOPE, "memory_id"]).withColumn(
        "budget", pk.token_budget(F.lit(0), _OPTIONS)
    )
    return pk.pack(rows, _OPTIONS), fixed, final


@query(
    "greedy_pack",
    _PACK_SQL
    + """
SELECT branch_id, query_id, n AS packed_count, len(taken) AS n_taken,
       CAST(CASE WHEN n = 0 THEN 0 ELSE cjk + ceil(other / 4.0) END AS INTEGER) AS estimated_tokens,
       over_budget AS skipped_by_token_budget, over_count AS skipped_by_count
FROM packed""",
)
def greedy_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)[0].select(
        "branch_id",
        "query_id",
        "packed_count",
        F.size("memory_ids").alias("n_taken"),
        "estimated_tokens",
        "skipped_by_token_budget",
        "skipped_by_count",
    )


@query(
    "render_memories",
    _PACK_SQL
    + f"""
SELECT p.branch_id, p.query_id,
       sha256(CASE WHEN p.n = 0 THEN '' ELSE {_HEADER_SQL} ||
         (SELECT string_agg(s.block, chr(10) || chr(10) ORDER BY s.start_floor, s.end_floor, s.memory_id) FROM sized s
          WHERE s.branch_id = p.branch_id AND s.query_id = p.query_id AND list_contains(p.taken, s.ord)) END) AS text_key
FROM packed p""",
)
def render_memories(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)[0].select(
        "branch_id", "query_id", F.sha2("text", 256).alias("text_key")
    )


@query(
    "pack_diagnostics",
    _PACK_SQL
    + """
SELECT p.branch_id, p.query_id,
       (SELECT count(*) FROM final f WHERE f.branch_id = p.branch_id AND f.query_id = p.query_id) AS recall_candidate_count,
       (SELECT count(*) FROM fixed f WHERE f.branch_id = p.branch_id) AS fixed_recent_candidate_count,
       (SELECT count(*) FROM sized s WHERE s.branch_id = p.branch_id AND s.query_id = p.query_id) AS deduplicated_count,
       p.n AS packed_count,
       (SELECT count(*) FROM sized s WHERE s.branch_id = p.branch_id AND s.query_id = p.query_id
          AND s.source = 'fixed_recent' AND list_contains(p.taken, s.ord)) AS packed_fixed_recent_count
FROM packed p""",
)
def pack_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    packed, fixed, final = _packed(spark, sf, counts=True)
    return pk.pack_diagnostics(packed, fixed, final).select(
        "branch_id",
        "query_id",
        "recall_candidate_count",
        "fixed_recent_candidate_count",
        "deduplicated_count",
        "packed_count",
        "packed_fixed_recent_count",
    )
