"""Selecting, mapping, suppressing, rendering and editing state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.base import FLOORS_SQL, REQUESTS_SQL, floors, query, requests, table
from registry.chats import _WINDOW_SQL, _window
from registry.quality import _character_rows
from turnledger.operators import context as cx
from turnledger.operators import overrides as ov
from turnledger.operators import pack as pk
from turnledger.operators.floors import SCOPE
from turnledger.operators.pack import QUERY

_NAMES = ["Ther", "Zanthor", "Entin", "Quorx", "The", "Die"]

# The state of each request: some of six characters, a scene, four plotlines, four plans.
_STATE_SQL = (
    _WINDOW_SQL
    + """,
texts AS (SELECT query_id, string_agg(content, chr(10) ORDER BY slot DESC) AS t FROM recent GROUP BY query_id),
corpus AS (SELECT r.*, lower(r.user_text || chr(10) || coalesce(t, '')) AS corpus FROM requests r LEFT JOIN texts USING (query_id)),
profiles AS (
  SELECT c.query_id, 'c' || k AS character_id, ['Ther', 'Zanthor', 'Entin', 'Quorx', 'The', 'Die'][k + 1] AS name, c.corpus, c.user_index
  FROM corpus c, range(0, 6) t(k) WHERE (c.user_index + k) % 4 <> 1
),
scene AS (SELECT query_id, ['c1', 'c9'] AS chars, ['p1', 'p9'] AS lines FROM requests WHERE user_index % 4 = 0),
plotlines AS (
  SELECT query_id, id, stage, stalled, pinned, chars FROM requests, (VALUES ('p0', '起线', FALSE, NULL, ['c2']), ('p1', '淡出', FALSE, NULL, ['c3']),
    ('p2', '淡出', TRUE, TRUE, ['c9', 'c5']), ('p3', '延展', TRUE, NULL, ['c0'])) v(id, stage, stalled, pinned, chars)
),
plans AS (
  SELECT query_id, id, status, pinned, chars, lines FROM requests, (VALUES ('a0', 'planned', NULL, ['c2'], CAST([] AS VARCHAR[])),
    ('a1', 'triggered', FALSE, ['c8'], ['p1']), ('a2', 'cancelled', TRUE, ['c2'], ['p0']), ('a3', 'planned', TRUE, ['c8'], ['p8'])) v(id, status, pinned, chars, lines)
),
alive AS (SELECT * FROM plotlines WHERE pinned OR (NOT stalled AND stage <> '淡出')),
chosen AS (
  SELECT query_id, character_id FROM profiles WHERE contains(corpus, lower(name)) OR contains(corpus, character_id)
  UNION SELECT p.query_id, p.character_id FROM profiles p JOIN scene s ON s.query_id = p.query_id AND list_contains(s.chars, p.character_id)
  UNION SELECT p.query_id, p.character_id FROM profiles p JOIN alive a ON a.query_id = p.query_id AND list_contains(a.chars, p.character_id)
),
lines AS (
  SELECT x.query_id, x.id AS plotline_id FROM plotlines x JOIN scene s ON s.query_id = x.query_id AND list_contains(s.lines, x.id)
  UNION SELECT a.query_id, a.id FROM alive a JOIN profiles p ON p.query_id = a.query_id AND list_contains(a.chars, p.character_id)
)"""
)


def _list(*items: str) -> F.Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def _state(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    asked = requests(spark, sf)
    corpus = cx.request_corpus(asked, pk.recent_context(_window(spark, sf)))
    people = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(f"c{k}").alias("character_id"), F.lit(n).alias("canonical_name"))
            for k, n in enumerate(_NAMES)
        ]
    )
    profiles = (
        asked.select(*QUERY, "user_index", F.inline(people))
        .filter((F.col("user_index") + F.col("k")) % 4 != 1)
        .select(*QUERY, "character_id", "canonical_name", _list().alias("aliases"))
    )
    now = asked.filter("user_index % 4 = 0").select(
        *QUERY,
        F.lit("n0").alias("id"),
        _list("c1", "c9").alias("related_character_ids"),
        _list("p1", "p9").alias("related_plotline_ids"),
    )

    def line(id_, stage, stalled, pinned, chars) -> F.Column:
        return F.struct(
            F.lit(id_).alias("id"),
            F.lit(stage).alias("stage"),
            F.lit(stalled).alias("stalled"),
            F.lit(pinned).cast("boolean").alias("pinned"),
            _list(*chars).alias("related_character_ids"),
        )

    plotlines = asked.select(
        *QUERY,
        F.inline(
            F.array(
                line("p0", "起线", False, None, ["c2"]),
                line("p1", "淡出", False, None, ["c3"]),
                line("p2", "淡出", True, True, ["c9", "c5"]),
                line("p3", "延展", True, None, ["c0"]),
            )
        ),
    )

    def plan(id_, status, pinned, chars, lines) -> F.Column:
        return F.struct(
            F.lit(id_).alias("id"),
            F.lit(status).alias("status"),
            F.lit(pinned).cast("boolean").alias("pinned"),
            _list(*chars).alias("related_character_ids"),
            _list(*lines).alias("related_plotline_ids"),
        )

    plans = asked.select(
        *QUERY,
        F.inline(
            F.array(
                plan("a0", "planned", None, ["c2"], []),
                plan("a1", "triggered", False, ["c8"], ["p1"]),
                plan("a2", "cancelled", True, ["c2"], ["p0"]),
                plan("a3", "planned", True, ["c8"], ["p8"]),
            )
        ),
    )
    return {"corpus": corpus, "profiles": profiles, "now": now, "plotlines": plotlines, "plans": plans}


def _characters(s: dict[str, DataFrame]) -> DataFrame:
    return cx.related_characters(s["corpus"], s["profiles"], s["now"], s["plotlines"])


@query("related_characters", _STATE_SQL + " SELECT query_id, character_id FROM chosen")
def related_characters(spark: SparkSession, sf: str) -> DataFrame:
    return _characters(_state(spark, sf)).select("query_id", "character_id")


@query("related_plotlines", _STATE_SQL + " SELECT query_id, plotline_id FROM lines")
def related_plotlines(spark: SparkSession, sf: str) -> DataFrame:
    s = _state(spark, sf)
    return cx.related_plotlines(s["profiles"], s["now"], s["plotlines"]).select("query_id", "plotline_id")


@query(
    "plan_filter",
    _STATE_SQL
    + """
SELECT p.query_id, p.id FROM plans p WHERE status IN ('planned', 'triggered') AND (pinned
  OR EXISTS (SELECT 1 FROM chosen c WHERE c.query_id = p.query_id AND list_contains(p.chars, c.character_id))
  OR EXISTS (SELECT 1 FROM lines l WHERE l.query_id = p.query_id AND list_contains(p.lines, l.plotline_id)))""",
)
def plan_filter(spark: SparkSession, sf: str) -> DataFrame:
    s = _state(spark, sf)
    lines = cx.related_plotlines(s["profiles"], s["now"], s["plotlines"])
    return cx.selected_plans(s["plans"], _characters(s), lines).select("query_id", "id")


# Orders are dated entries; each customer asks on the day of their latest order, a few without a date.
_CALENDAR_SQL = """
WITH entries AS (
  SELECT CAST(o_custkey % 400 AS VARCHAR) AS query_id, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderstatus <> 'P' AS confirmed, 'c' || o_custkey AS who
  FROM orders
),
today AS (SELECT query_id, CASE WHEN CAST(query_id AS INTEGER) % 40 = 7 THEN NULL ELSE max(d) - 3 END AS t FROM entries GROUP BY query_id)
SELECT e.query_id, e.id FROM entries e JOIN today USING (query_id)
WHERE confirmed AND (t IS NULL OR abs(e.d - t) <= 1 OR e.who = 'c' || e.query_id)"""


@query("calendar_proximity", _CALENDAR_SQL)
def calendar_proximity(spark: SparkSession, sf: str) -> DataFrame:
    ask = (F.col("o_custkey") % 400).cast("string")
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, sf, "orders")
    key = [F.lit("shop").alias("chat_id"), F.lit("main").alias("branch_id"), ask.alias("query_id")]
    entries = orders.select(
        *key,
        F.col("o_orderkey").alias("id"),
        F.concat(day.cast("string"), F.lit(" 10:00")).alias("date_key"),
        (F.col("o_orderstatus") != "P").alias("confirmed"),
        F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("related_character_ids"),
    )
    times = (
        orders.groupBy(*key)
        .agg(F.date_sub(F.max(day), 3).cast("string").alias("t"))
        .select(*QUERY, F.when(F.col("query_id").cast("int") % 40 == 7, "Day 3").otherwise(F.col("t")).alias("current_time"))
    )
    people = times.select(*QUERY, F.concat(F.lit("c"), "query_id").alias("character_id"))
    return cx.selected_calendar(entries, times, people).select("query_id", "id")


# ---------------------------------------------------------------- external state

_MAPPINGS = [
    ("m0", "p.k", "profile", "basic.age", "c1", None, None, "equivalent", True),
    ("m1", "p.none", "profile", "basic.age", "c1", None, None, "equivalent", True),
    ("m2", "p.k", "profile", "basic.age", None, None, None, "equivalent", True),
    ("m3", "list[0].x", "trace", "currentSituations", "c1", None, None, "equivalent", True),
    ("m4", "list[0].x", "trace", "currentSituations.s1", "c1", None, None, "equivalent", True),
    ("m5", "p.k", "story", "calendar", None, "e1", None, "related", True),
    ("m6", "p.k", "story", "now.currentTime", None, None, None, "equivalent", False),
    ("m7", "p.k", "story", "plotlines", None, None, "gate", "other", True),
    ("m8", "p.k", "story", "plotlines", None, None, "gate", "equivalent", True),
    ("m9", "p.k", "profile", "basic.age", "c1", None, None, "equivalent", True),
]


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    names = ["mapping_id", "external_path", "domain", "path", "character_id", "item_id", "semantic_key", "mode", "enabled"]
    rows = F.array(
        *[
            F.struct(*[F.lit(v).cast("boolean" if n == "enabled" else "string").alias(n) for n, v in zip(names, m)])
            for m in _MAPPINGS
        ]
    )
    base = table(spark, sf, "events").select(
        F.lit("x").alias("chat_id"),
        F.lit("main").alias("branch_id"),
        F.col("event_id").cast("string").alias("query_id"),
        F.when(
            F.col("event_id") % 5 != 4, F.concat(F.lit('{"p":'), "props", F.lit(',"list":[{"x":1}]}'))
        ).alias("document"),
    )
    mappings = base.select(*QUERY, F.inline(rows), F.lit(None).cast("string").alias("field"))
    return cx.resolve_mappings(mappings, base)


_OUTCOMES_SQL = """
WITH outcomes AS (
  SELECT CAST(event_id AS VARCHAR) AS query_id, m AS mapping_id, outcome FROM events, (VALUES ('m0', 'equivalent'), ('m1', 'external path not found'),
    ('m2', 'unsupported target'), ('m3', 'unsupported target'), ('m4', 'equivalent'), ('m5', 'related'), ('m6', 'target is missing'),
    ('m7', 'unsupported mode'), ('m8', 'equivalent'), ('m9', 'equivalent')) v(m, outcome) WHERE event_id % 5 <> 4
)"""


@query("external_mapping", _OUTCOMES_SQL + " SELECT * FROM outcomes")
def external_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("query_id", "mapping_id", "outcome")


@query(
    "suppressed_slots",
    """
SELECT CAST(event_id AS VARCHAR) AS query_id, domain, character_id, field, semantic_key FROM events, (VALUES ('profile', 'c1', 'basic.age', NULL),
  ('trace', 'c1', 'currentSituations', 's1'), ('story', NULL, 'plotlines', 'gate')) v(domain, character_id, field, semantic_key) WHERE event_id % 5 <> 4""",
)
def suppressed_slots(spark: SparkSession, sf: str) -> DataFrame:
    return cx.suppressions(_resolved(spark, sf)).select("query_id", "domain", "character_id", "field", "semantic_key")


@query(
    "item_suppression",
    """
SELECT CAST(event_id AS VARCHAR) AS query_id, id FROM events, (VALUES ('s1', 'c1'), ('s2', 'c1'), ('s1b', 'c2'), ('l1', NULL), ('l2', NULL)) v(id, who)
WHERE event_id % 5 = 4 OR (NOT (who = 'c1' AND id = 's1') AND id <> 'l1') OR who = 'c2'""",
)
def item_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """Situations of two characters and two plotlines, one of which mentions the gate."""
    def item(domain, who, field, id_, text) -> F.Column:
        return F.struct(
            F.lit(domain).alias("domain"), F.lit(who).cast("string").alias("character_id"),
            F.lit(field).alias("field"), F.lit(id_).alias("id"), F.lit(text).alias("text"),
        )

    items = table(spark, sf, "events").select(
        F.lit("x").alias("chat_id"), F.lit("main").alias("branch_id"), F.col("event_id").cast("string").alias("query_id"),
        F.inline(
            F.array(
                item("trace", "c1", "currentSituations", "s1", "hurt"),
                item("trace", "c1", "currentSituations", "s2", "tired"),
                item("trace", "c2", "currentSituations", "s1b", "has s1"),
                item("story", None, "plotlines", "l1", "The gate opens"),
                item("story", None, "plotlines", "l2", "The wall falls"),
            )
        ),
    )
    return cx.visible_items(items, cx.suppressions(_resolved(spark, sf))).select("query_id", "id")


@query(
    "field_suppression",
    """
SELECT CAST(event_id AS VARCHAR) AS query_id, who AS character_id, sub AS sub_field FROM events, (VALUES ('c1', 'age'), ('c1', 'race'), ('c2', 'age')) v(who, sub)
WHERE event_id % 5 = 4 OR NOT (who = 'c1' AND sub = 'age')""",
)
def field_suppression(spark: SparkSession, sf: str) -> DataFrame:
    def field(who, sub) -> F.Column:
        return F.struct(F.lit("profile").alias("domain"), F.lit(who).alias("character_id"), F.lit("basic").alias("field"), F.lit(sub).alias("sub_field"))

    fields = table(spark, sf, "events").select(
        F.lit("x").alias("chat_id"), F.lit("main").alias("branch_id"), F.col("event_id").cast("string").alias("query_id"),
        F.inline(F.array(field("c1", "age"), field("c1", "race"), field("c2", "age"))),
    )
    return cx.visible_fields(fields, cx.suppressions(_resolved(spark, sf))).select("query_id", "character_id", "sub_field")


# ---------------------------------------------------------------- rendering


def _q(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


_SECTION_SQL = " || chr(10) || chr(10) || ".join(
    [
        _q(cx.INTRO),
        f"{_q(cx.SECTIONS['profiles'][0])} || chr(10) || coalesce((SELECT string_agg('- {{\"canonicalName\":\"' || p.name || '\",\"basic\":{{\"age\":\"1' || substr(p.character_id, 2) || '\",\"race\":\"r\"}}}}', chr(10) ORDER BY p.character_id) "
        f"FROM profiles p JOIN chosen c ON c.query_id = p.query_id AND c.character_id = p.character_id WHERE p.query_id = r.query_id), {_q(cx.SECTIONS['profiles'][1])})",
        f"{_q(cx.SECTIONS['traces'][0] + chr(10) + cx.SECTIONS['traces'][1])}",
        f"{_q(cx.SECTIONS['now'][0] + chr(10) + cx.SECTIONS['now'][1])}",
        f"{_q(cx.SECTIONS['recent'][0])} || chr(10) || coalesce((SELECT string_agg('- AI楼 ' || x.message_index || '（原文）：' || x.content, chr(10) ORDER BY x.message_index) FROM recent x WHERE x.query_id = r.query_id), {_q(cx.SECTIONS['recent'][1])})",
        f"{_q(cx.SECTIONS['calendar'][0] + chr(10) + cx.SECTIONS['calendar'][1])}",
        f"{_q(cx.SECTIONS['plotlines'][0])} || chr(10) || coalesce((SELECT string_agg('- {{\"id\":\"' || l.plotline_id || '\"}}', chr(10) ORDER BY l.plotline_id) FROM lines l WHERE l.query_id = r.query_id), {_q(cx.SECTIONS['plotlines'][1])})",
        f"{_q(cx.SECTIONS['plans'][0] + chr(10) + cx.SECTIONS['plans'][1])}",
    ]
)


@query(
    "render_current_state",
    _STATE_SQL + f" SELECT r.query_id, sha256({_SECTION_SQL}) AS text_key FROM requests r",
)
def render_current_state(spark: SparkSession, sf: str) -> DataFrame:
    s = _state(spark, sf)
    chosen = _characters(s)
    base = F.concat(F.lit("/profiles/"), "character_id")
    number = F.substring("character_id", 2, 9)
    rows = s["profiles"].select(
        *QUERY,
        F.inline(
            F.array(
                F.struct(F.concat(base, F.lit("/canonicalName")).alias("path"), F.concat(F.lit('"'), "canonical_name", F.lit('"')).alias("value")),
                F.struct(F.concat(base, F.lit("/basic/age")).alias("path"), F.concat(F.lit('"1'), number, F.lit('"')).alias("value")),
                F.struct(F.concat(base, F.lit("/basic/race")).alias("path"), F.lit('"r"').alias("value")),
            )
        ),
    )
    people = cx.entity_json(cx.profile_fields(rows, chosen), [*QUERY, "character_id"])
    lines = cx.related_plotlines(s["profiles"], s["now"], s["plotlines"])
    rendered = cx.render_state(
        requests(spark, sf),
        {
            "profiles": people.withColumnRenamed("character_id", "ord"),
            "recent": cx.recent_lines(pk.recent_context(_window(spark, sf))),
            "plotlines": lines.select(
                *QUERY, F.col("plotline_id").alias("ord"), F.concat(F.lit('- {"id":"'), "plotline_id", F.lit('"}')).alias("line")
            ),
        },
    )
    return rendered.select("query_id", F.sha2("text", 256).alias("text_key"))


# ---------------------------------------------------------------- manual edits

# Each customer's character is edited in one of several ways.
_EDIT_SQL = """
WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS branch_id, c_custkey AS k, '/profiles/c' || c_custkey AS p FROM customer WHERE c_nationkey <> 3)"""


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    case = F.floor(k / 4) % 6
    return table(spark, sf, "customer").select(
        F.lit("world").alias("chat_id"),
        F.col("c_nationkey").cast("string").alias("branch_id"),
        k.alias("edit_seq"),
        F.when(case == 5, "world").otherwise("profile").alias("target"),
        F.concat(F.lit("c"), k.cast("string")).alias("entity_id"),
        F.when(case == 4, "basic.color").when(case == 1, "canonicalName").when(case == 3, "identity.background").otherwise("basic.age").alias("field_path"),
        F.when(case == 0, '"33"').when(case == 1, '""').alias("value"),
        F.when(case == 2, "unlock").when(case == 3, "lock").alias("action"),
    )


def _override(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _character_rows(spark, sf).withColumn("kind", F.lit("value"))
    heads = rows.filter("branch_id <> '3'").select(*SCOPE).distinct()
    good, bad = ov.check_overrides(_edits(spark, sf), heads)
    return rows, ov.override_events(good, rows), bad


@query(
    "manual_override",
    _EDIT_SQL
    + """
SELECT branch_id, p || '/basic/age' AS path, 'replace' AS op, '"33"' AS value FROM c WHERE k // 4 % 6 = 0
UNION ALL SELECT branch_id, p || '/sourcePriority/basic.age', 'replace', '"manual"' FROM c WHERE k // 4 % 6 = 0
UNION ALL SELECT branch_id, p || '/canonicalName', 'remove', NULL FROM c WHERE k // 4 % 6 = 1
UNION ALL SELECT branch_id, p || '/sourcePriority/canonicalName', 'replace', '"manual"' FROM c WHERE k // 4 % 6 = 1
UNION ALL SELECT branch_id, p || '/lockedPaths', 'replace', CASE WHEN k % 4 = 0 THEN '[]' ELSE '["identity"]' END FROM c WHERE k // 4 % 6 = 2
UNION ALL SELECT branch_id, p || '/lockedPaths', 'replace', CASE WHEN k % 4 = 0 THEN '["identity.background"]' ELSE '["basic.age","identity","identity.background"]' END FROM c WHERE k // 4 % 6 = 3
UNION ALL SELECT branch_id, p || '/canonicalName', 'replace', '"c' || k || '"' FROM c WHERE k % 4 = 0 AND k // 4 % 6 IN (0, 2, 3)""",
)
def manual_override(spark: SparkSession, sf: str) -> DataFrame:
    return _override(spark, sf)[1].select("branch_id", "path", "op", "value")


@query(
    "manual_override_rejects",
    """
SELECT c_custkey AS edit_seq, CASE WHEN c_nationkey = 3 THEN 'the branch has no valid state node' WHEN c_custkey // 4 % 6 = 5 THEN 'invalid target' ELSE 'unknown profile field' END AS reason
FROM customer WHERE c_nationkey = 3 OR c_custkey // 4 % 6 IN (4, 5)""",
)
def manual_override_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _override(spark, sf)[2].select("edit_seq", "reason")
