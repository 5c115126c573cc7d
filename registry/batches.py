"""Memory batches: ranges, inputs, reuse, staleness, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.base import BLOCK, CHAIN_SQL, MEMORIES_SQL, event_floors, memories, nodes, query, table
from turnledger.functions.keys import fingerprint
from turnledger.operators import memory as mem
from turnledger.operators.floors import SCOPE

# Ranges of ten synced nodes. Stored batches: some scopes use ranges of seven, some ranges
# are missing, some are stale, some have a second, older version.
RANGES_SQL = f"""
WITH {CHAIN_SQL},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY message_index) AS n,
         count(*) OVER (PARTITION BY chat_id) AS total
  FROM nodes WHERE status = 'synced'
),
expected AS (
  SELECT chat_id, branch_id, (n - 1) // 10 * 10 + 1 AS batch_start_floor, ((n - 1) // 10 + 1) * 10 AS batch_end_floor
  FROM numbered GROUP BY ALL HAVING count(*) = 10
),
sevens AS (
  SELECT chat_id, branch_id, (n - 1) // 7 * 7 + 1 AS batch_start_floor, ((n - 1) // 7 + 1) * 7 AS batch_end_floor
  FROM numbered WHERE CAST(chat_id AS BIGINT) % 4 = 0 GROUP BY ALL HAVING count(*) = 7
),
batches AS (
  SELECT 'a:' || chat_id || ':' || batch_start_floor AS batch_id, *, batch_start_floor % 30 = 11 AS stale, 2 AS created_at, 3 AS updated_at
  FROM expected WHERE CAST(chat_id AS BIGINT) % 4 <> 0 AND batch_start_floor % 40 <> 21
  UNION ALL SELECT 'b:' || chat_id || ':' || batch_start_floor, *, FALSE, 2, 3 FROM sevens
  UNION ALL SELECT 'c:' || chat_id || ':' || batch_start_floor, *, TRUE, CASE WHEN batch_start_floor % 20 = 1 THEN 1 ELSE 2 END, 3 FROM expected
    WHERE CAST(chat_id AS BIGINT) % 4 = 1
)"""


def _expected(spark: SparkSession, sf: str, n: int = 10) -> DataFrame:
    return mem.expected_ranges(nodes(spark, sf), n, BLOCK)


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    chat, start = F.col("chat_id").cast("bigint"), F.col("batch_start_floor")

    def made(prefix: str, rows: DataFrame, stale, created) -> DataFrame:
        return rows.select(
            F.concat_ws(":", F.lit(prefix), "chat_id", start.cast("string")).alias("batch_id"),
            *mem.RANGE,
            stale.alias("stale"),
            created.alias("created_at"),
            F.lit(3).alias("updated_at"),
        )

    tens = _expected(spark, sf)
    first = made("a", tens.filter((chat % 4 != 0) & (start % 40 != 21)), start % 30 == 11, F.lit(2))
    sevens = made("b", _expected(spark, sf, 7).filter(chat % 4 == 0), F.lit(False), F.lit(2))
    older = made(
        "c", tens.filter(chat % 4 == 1), F.lit(True), F.when(start % 20 == 1, 1).otherwise(2)
    )
    return first.unionByName(sevens).unionByName(older)


@query("batch_ranges", RANGES_SQL + " SELECT * FROM expected")
def batch_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return _expected(spark, sf)


@query(
    "batch_range_mismatch",
    RANGES_SQL
    + """
SELECT batch_id FROM batches b WHERE NOT stale AND EXISTS (
  SELECT 1 FROM batches x WHERE x.chat_id = b.chat_id AND NOT x.stale AND NOT EXISTS (
    SELECT 1 FROM expected e WHERE e.chat_id = x.chat_id AND e.batch_start_floor = x.batch_start_floor AND e.batch_end_floor = x.batch_end_floor))
  AND EXISTS (SELECT 1 FROM expected e WHERE e.chat_id = b.chat_id)""",
)
def batch_range_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return mem.mismatched_batches(_batches(spark, sf), _expected(spark, sf)).select("batch_id")


@query(
    "batch_hole_filling",
    RANGES_SQL
    + """
SELECT e.* FROM expected e WHERE NOT EXISTS (SELECT 1 FROM batches b WHERE NOT b.stale AND b.chat_id = e.chat_id
  AND b.batch_start_floor = e.batch_start_floor AND b.batch_end_floor = e.batch_end_floor)""",
)
def batch_hole_filling(spark: SparkSession, sf: str) -> DataFrame:
    return mem.missing_ranges(_batches(spark, sf), _expected(spark, sf))


# Ranges to summarise: every expected one, plus one that runs past the end of each chat.
_INPUTS_SQL = (
    RANGES_SQL
    + """,
wanted AS (
  SELECT chat_id, branch_id, batch_start_floor, batch_end_floor FROM expected
  UNION ALL SELECT chat_id, branch_id, max(total) - 3, max(total) + 3 FROM numbered GROUP BY ALL
),
texts AS (SELECT floor_id, content FROM event_floors WHERE event_id % 211 <> 0),
members AS (
  SELECT w.*, x.n, x.floor_id, t.content, x.state_node_id, x.state_fingerprint, 'd:' || x.state_node_id AS delta
  FROM wanted w JOIN numbered x ON x.chat_id = w.chat_id AND x.n BETWEEN w.batch_start_floor AND w.batch_end_floor
  LEFT JOIN texts t ON t.floor_id = x.floor_id
),
inputs AS (
  SELECT chat_id, branch_id, batch_start_floor, batch_end_floor, count(*) AS n_floors, count(content) AS n_texts,
         max_by(state_node_id, n) AS end_state_node_id, max_by(state_fingerprint, n) AS end_fp,
         list(floor_id ORDER BY n) AS floor_ids,
         string_agg('{"floorId":"' || floor_id || '","contentFingerprint":"sha256:' || sha256(content) || '"}', ',' ORDER BY n) AS sources,
         string_agg('"' || delta || '"', ',' ORDER BY n) AS deltas,
         CASE WHEN count(*) <> batch_end_floor - batch_start_floor + 1 THEN 'range requires synchronized floors'
              WHEN count(content) <> count(*) THEN 'source floors unavailable' END AS reason
  FROM members GROUP BY chat_id, branch_id, batch_start_floor, batch_end_floor
)"""
)


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    made = nodes(spark, sf)
    totals = made.filter("status = 'synced'").groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("t"))
    over = totals.select(
        *SCOPE, (F.col("t") - 3).alias("batch_start_floor"), (F.col("t") + 3).alias("batch_end_floor")
    )
    texts = event_floors(spark, sf).select(
        "floor_id", "chat_id", "content", (F.col("event_id") % 211 != 0).alias("active")
    )
    deltas = made.select("state_node_id", F.concat(F.lit("d:"), "state_node_id").alias("delta"))
    return mem.range_inputs(_expected(spark, sf).unionByName(over), made, texts, deltas, BLOCK)


@query(
    "batch_range_inputs",
    _INPUTS_SQL
    + """
SELECT chat_id, batch_start_floor, batch_end_floor, reason, n_floors, array_to_string(floor_ids, ',') AS floor_ids, end_state_node_id FROM inputs""",
)
def batch_range_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return _inputs(spark, sf).select(
        "chat_id",
        "batch_start_floor",
        "batch_end_floor",
        "reason",
        F.size("floors").alias("n_floors"),
        F.array_join(F.transform("floors", lambda f: f["floor_id"]), ",").alias("floor_ids"),
        "end_state_node_id",
    )


_DEPENDENCY_SQL = """'sha256:' || sha256('{"branchId":"' || branch_id || '","batchStartFloor":' || batch_start_floor || ',"batchEndFloor":' || batch_end_floor
  || ',"sourceFloors":[' || sources || '],"stateDeltas":[' || deltas || '],"endStateFingerprint":"' || end_fp || '","prompt":"q1"}')"""


@query(
    "batch_dependency",
    _INPUTS_SQL
    + f" SELECT chat_id, batch_start_floor, {_DEPENDENCY_SQL} AS dependency FROM inputs WHERE reason IS NULL",
)
def batch_dependency(spark: SparkSession, sf: str) -> DataFrame:
    return _inputs(spark, sf).filter("reason is null").select(
        "chat_id", "batch_start_floor", mem.batch_dependency(F.lit("q1")).alias("dependency")
    )


@query(
    "batch_reuse",
    _INPUTS_SQL
    + """
SELECT chat_id, batch_start_floor,
       CASE WHEN CAST(chat_id AS BIGINT) % 3 = 1 AND batch_start_floor % 20 = 1 THEN 'old:' || chat_id || ':' || batch_start_floor END AS batch_id
FROM inputs WHERE reason IS NULL""",
)
def batch_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """One chat in three stored every dependency; half of those batches have no slices."""
    ready = _inputs(spark, sf).filter("reason is null").select(
        *mem.RANGE, mem.batch_dependency(F.lit("q1")).alias("batch_dependency_fingerprint")
    )
    stored = ready.filter("cast(chat_id as bigint) % 3 = 1").withColumn(
        "batch_id", F.concat_ws(":", F.lit("old"), "chat_id", F.col("batch_start_floor").cast("string"))
    )
    slices = stored.filter("batch_start_floor % 20 = 1").select("batch_id")
    return mem.reusable_batches(ready, stored, slices).select(
        "chat_id", "batch_start_floor", "batch_id"
    )


@query(
    "batch_reactivate",
    RANGES_SQL
    + """
SELECT batch_id, CASE WHEN CAST(chat_id AS BIGINT) % 4 = 1 AND EXISTS (
    SELECT 1 FROM batches c WHERE c.batch_id LIKE 'c:%' AND c.chat_id = b.chat_id AND c.batch_start_floor = b.batch_start_floor AND c.batch_end_floor = b.batch_end_floor)
  THEN batch_id NOT LIKE 'c:%' ELSE stale END AS stale FROM batches b""",
)
def batch_reactivate(spark: SparkSession, sf: str) -> DataFrame:
    rows = _batches(spark, sf)
    return mem.activate_batches(rows, rows.filter("batch_id like 'c:%'")).select("batch_id", "stale")


@query(
    "batch_supersede",
    RANGES_SQL
    + """
SELECT batch_id, stale OR batch_start_floor % 20 = 1 AND batch_end_floor % 10 = 0 AS stale FROM batches
UNION ALL SELECT 'new:' || chat_id || ':' || batch_start_floor, FALSE FROM expected WHERE batch_start_floor % 20 = 1""",
)
def batch_supersede(spark: SparkSession, sf: str) -> DataFrame:
    new = (
        _expected(spark, sf)
        .filter("batch_start_floor % 20 = 1")
        .select(
            F.concat_ws(":", F.lit("new"), "chat_id", F.col("batch_start_floor").cast("string")).alias("batch_id"),
            *mem.RANGE,
            F.lit(False).alias("stale"),
            F.lit(9).alias("created_at"),
            F.lit(9).alias("updated_at"),
        )
    )
    return mem.supersede(_batches(spark, sf), new).select("batch_id", "stale")


@query(
    "batch_stale_by_floors",
    _INPUTS_SQL
    + """
SELECT chat_id, batch_start_floor FROM inputs WHERE len(list_filter(floor_ids, lambda f: CAST(substr(f, 2) AS BIGINT) % 50 = 7)) > 0""",
)
def batch_stale_by_floors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _inputs(spark, sf).select(
        *mem.RANGE,
        F.concat_ws(":", "chat_id", F.col("batch_start_floor").cast("string")).alias("batch_id"),
        F.transform("floors", lambda f: f["floor_id"]).alias("source_floor_ids"),
    )
    edited = event_floors(spark, sf).filter("event_id % 50 = 7").select("floor_id")
    return mem.stale_by_floors(rows, edited).select("chat_id", "batch_start_floor")


@query(
    "batch_single_survivor",
    RANGES_SQL
    + """
SELECT batch_id, row_number() OVER (PARTITION BY chat_id, batch_start_floor, batch_end_floor
  ORDER BY updated_at DESC, created_at DESC, batch_id DESC) > 1 AS stale FROM batches""",
)
def batch_single_survivor(spark: SparkSession, sf: str) -> DataFrame:
    return mem.single_survivor(_batches(spark, sf)).select("batch_id", "stale")


@query(
    "batch_prompt_invalidation",
    RANGES_SQL + " SELECT batch_id, stale OR batch_start_floor % 3 = 1 AS stale FROM batches",
)
def batch_prompt_invalidation(spark: SparkSession, sf: str) -> DataFrame:
    rows = _batches(spark, sf).withColumn(
        "prompt_version", F.when(F.col("batch_start_floor") % 3 == 1, "q0").otherwise("q1")
    )
    return mem.invalidate_prompt(rows, "q1").select("batch_id", "stale")


@query("batch_scopes", RANGES_SQL + " SELECT DISTINCT chat_id, branch_id FROM batches")
def batch_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return mem.list_scopes(_batches(spark, sf))


# Model answers built from documents: slices inside and outside the range, blank texts, noise.
_OUTPUT_SQL = """
WITH docs AS (SELECT doc_id, source, lang, doc_id % 9 AS c FROM documents)"""


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    case = doc % 9
    tags = F.concat(F.lit('["'), "lang", F.lit('", 5, " ", "'), "source", F.lit('", "'), "lang", F.lit('"]'))
    first = F.concat(
        F.lit('{"startFloor": 1, "endFloor": 4, "title": "  T '), "source",
        F.lit(' ", "summary": " first '), doc.cast("string"), F.lit(' ", "tags": '), tags, F.lit("}"),
    )
    second = F.concat(
        F.lit('{"startFloor": '), F.when(case == 3, "8").otherwise("5"), F.lit(', "endFloor": '),
        F.when(case == 4, "11").otherwise("7"), F.lit(', "title": 3, "summary": "'),
        F.when(case == 5, "   ").otherwise("second"), F.lit('", "narrativeTime": "day 2"}'),
    )
    whole = F.concat(F.lit('{"slices": ['), first, F.lit(", "), second, F.lit("]}"))
    output = (
        F.when(case == 6, "not json").when(case == 7, '{"slices": 5}').when(case == 8, '{"slices": []}').otherwise(whole)
    )
    return table(spark, sf, "documents").select(
        F.lit("docs").alias("chat_id"),
        F.col("lang").alias("branch_id"),
        F.lit(1).cast("bigint").alias("batch_start_floor"),
        F.lit(10).cast("bigint").alias("batch_end_floor"),
        doc.cast("string").alias("batch_id"),
        output.alias("output"),
    )


@query(
    "slice_validation",
    _OUTPUT_SQL
    + """
SELECT CAST(doc_id AS VARCHAR) AS batch_id, 1 AS slice_number, 1 AS start_floor, 4 AS end_floor, 'T ' || source AS title,
       'first ' || doc_id AS summary, lang || ',' || source AS tags, CAST(NULL AS VARCHAR) AS narrative_time FROM docs WHERE c <= 2
UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, 5, 7, NULL, 'second', '', 'day 2' FROM docs WHERE c <= 2""",
)
def slice_validation(spark: SparkSession, sf: str) -> DataFrame:
    slices, _ = mem.parse_slices(_outputs(spark, sf))
    return slices.select(
        "batch_id",
        "slice_number",
        "start_floor",
        "end_floor",
        "title",
        "summary",
        F.array_join("tags", ",").alias("tags"),
        "narrative_time",
    )


@query(
    "slice_rejects",
    _OUTPUT_SQL
    + """
SELECT CAST(doc_id AS VARCHAR) AS batch_id, CASE c WHEN 6 THEN 'output is not JSON' WHEN 7 THEN 'output must contain slices' ELSE 'invalid slice 2' END AS reason
FROM docs WHERE c BETWEEN 3 AND 7""",
)
def slice_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = mem.parse_slices(_outputs(spark, sf))
    return rejected.select("batch_id", "reason")


@query(
    "slice_sources",
    _INPUTS_SQL
    + """
SELECT chat_id, batch_start_floor, array_to_string(floor_ids[3:6], ',') AS source_floor_ids FROM inputs WHERE reason IS NULL""",
)
def slice_sources(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform("floors", lambda f: f["floor_id"])
    start = F.col("batch_start_floor")
    return _inputs(spark, sf).filter("reason is null").select(
        "chat_id",
        "batch_start_floor",
        F.array_join(mem.slice_sources(ids, start, start + 2, start + 5), ",").alias("source_floor_ids"),
    )


@query(
    "batch_summaries",
    _INPUTS_SQL
    + """,
spoken AS (
  SELECT chat_id, batch_start_floor, batch_end_floor, string_agg(content, ' / ' ORDER BY n) AS summary
  FROM members GROUP BY ALL
)
SELECT i.chat_id, i.batch_start_floor, s.summary FROM inputs i JOIN spoken s
ON s.chat_id = i.chat_id AND s.batch_start_floor = i.batch_start_floor AND s.batch_end_floor = i.batch_end_floor WHERE i.reason IS NULL""",
)
def batch_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The deterministic summariser over every complete range, parsed into slices."""
    ready = _inputs(spark, sf).filter("reason is null").select(
        *mem.RANGE,
        F.concat_ws(":", "chat_id", F.col("batch_start_floor").cast("string")).alias("batch_id"),
        mem.batch_dependency(F.lit("q1")).alias("batch_dependency_fingerprint"),
        "floors",
    )
    made = mem.summarise(ready, mem.extractive_summariser)
    slices, _ = mem.parse_slices(made.filter("error is null"))
    return slices.select("chat_id", "batch_start_floor", "summary")


@query(
    "memory_toggle",
    f"""
WITH {MEMORIES_SQL}
SELECT memory_id, CASE WHEN CAST(memory_id AS BIGINT) % 4 = 0 THEN TRUE
  WHEN CAST(memory_id AS BIGINT) % 4 = 1 AND CAST(memory_id AS BIGINT) % 3 <> 0 THEN FALSE ELSE stale END AS stale
FROM memories""",
)
def memory_toggle(spark: SparkSession, sf: str) -> DataFrame:
    rows, batches, toggles = _toggle_inputs(spark, sf)
    return mem.toggle_memories(rows, batches, toggles)[0].select("memory_id", "stale")


@query(
    "memory_toggle_rejects",
    f"""
WITH {MEMORIES_SQL}
SELECT memory_id, 'its batch is stale' AS reason FROM memories WHERE CAST(memory_id AS BIGINT) % 4 = 1 AND CAST(memory_id AS BIGINT) % 3 = 0
UNION ALL SELECT 'lost:' || memory_id, 'memory does not exist' FROM memories WHERE CAST(memory_id AS BIGINT) % 50 = 3""",
)
def memory_toggle_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return mem.toggle_memories(*_toggle_inputs(spark, sf))[1]


def _toggle_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    doc = F.col("memory_id").cast("bigint")
    rows = memories(spark, sf).withColumn("batch_id", F.concat(F.lit("b"), "memory_id"))
    batches = rows.select("batch_id", (doc % 3 == 0).alias("stale"))
    known = rows.filter(doc % 4 < 2).select("memory_id", (doc % 4 == 0).alias("stale"))
    lost = rows.filter(doc % 50 == 3).select(
        F.concat(F.lit("lost:"), "memory_id").alias("memory_id"), F.lit(True).alias("stale")
    )
    return rows, batches, known.unionByName(lost)


@query(
    "memory_scan",
    f"""
WITH {MEMORIES_SQL}
SELECT memory_id, start_floor, array_to_string(list_sort(tags), ',') AS tags, array_to_string(character_ids, ',') AS character_ids,
       array_to_string(plotline_ids, ',') AS plotline_ids
FROM memories WHERE chat_id = 'docs' AND branch_id = 'en' AND NOT stale""",
)
def memory_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf).withColumn("slice_id", F.col("memory_id"))
    parents = rows.drop("tags", "character_ids", "plotline_ids")
    listed = mem.list_memories(parents, "docs", "en")
    whole = mem.attach_children(
        listed,
        mem.child_rows(rows, "tags", "tag"),
        mem.child_rows(rows, "character_ids", "character_id"),
        mem.child_rows(rows, "plotline_ids", "plotline_id"),
    )
    return whole.select(
        "memory_id",
        "start_floor",
        F.array_join("tags", ",").alias("tags"),
        F.array_join("character_ids", ",").alias("character_ids"),
        F.array_join("plotline_ids", ",").alias("plotline_ids"),
    )


@query(
    "memory_tag_rows",
    f"WITH {MEMORIES_SQL} SELECT memory_id, unnest(tags) AS tag FROM memories",
)
def memory_tag_rows(spark: SparkSession, sf: str) -> DataFrame:
    return mem.child_rows(memories(spark, sf), "tags", "tag")


@query(
    "delta_fetch",
    f"WITH {CHAIN_SQL} SELECT state_node_id, 'd:' || state_node_id AS delta FROM nodes WHERE message_index % 3 = 0",
)
def delta_fetch(spark: SparkSession, sf: str) -> DataFrame:
    made = nodes(spark, sf)
    deltas = made.select("state_node_id", F.concat(F.lit("d:"), "state_node_id").alias("delta"))
    wanted = made.filter("message_index % 3 = 0").select("state_node_id")
    return deltas.join(wanted, "state_node_id", "left_semi")
