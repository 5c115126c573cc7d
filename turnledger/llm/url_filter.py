"""URL filter: rules by host and path, then naive Bayes over the words inside host names.

``rule_of`` finds the longest rule that fits; rules are a short list that the caller passes.
Other URLs are judged by a model learned from those that a rule decides:

* Words are counted over the pages' texts. Every part of a host name that is a run of letters
  is cut into words by unigram Viterbi: all its substrings meet the counts in a join, then one
  small task row finds the likeliest cut. Different runs are cut once, however many pages have
  them.
* Multinomial naive Bayes counts the words of hosts and the tokens of paths in allowed and
  blocked URLs. Log ratios are whole millionths, so sums do not depend on their order. Hosts
  are scored once each; path tokens meet their weights in a join.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, fits no rule and
is judged by the prior alone; without both labels among the rules' URLs every other URL takes
the one label there is, and ``allow`` if there is none; equal page ids are judged row by row; a
host label of more than 63 bytes is no DNS label and stays one token; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.stages import written

#: Longest word that a host name is cut into.
LONGEST = 24
#: Longest label of a DNS name.
LABEL = 63
#: Log ratios are stored as whole multiples of this part.
UNIT = 1_000_000

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]  # verdict, host, path

#: The rules of the registered query.
RULES: list[Rule] = [
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null without one."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


_MARKUP = r"(?s)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^<>]*>|&#?\w+;"


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """Letters a to z of all texts, tags taken out, as words with their numbers."""
    plain = lower_ascii(F.regexp_replace(F.col(text_col), _MARKUP, " "))
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def cut(run: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """Likeliest words of a run of letters. ``found``: (start, length, count) of its known
    substrings. An unknown word costs as much as one seen once and a tenfold for each letter.
    Among equal cuts the one with the shorter last word stays."""
    known = {(at, size): n for at, size, n in found}
    scale = math.log(total + 1)
    best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for size in range(1, min(end, LONGEST) + 1):
            n = known.get((end - size, size), 0)
            score = best[end - size] + (math.log(n) if n else -size * math.log(10)) - scale
            if score > best[end]:
                best[end], back[end] = score, size
    words, end = [], len(run)
    while end:
        words.append(run[end - back[end] : end])
        end -= back[end]
    return words[::-1]


def _cutter(total: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, found = batch.column("run").to_pylist(), batch.column("found").to_pylist()
            words = [cut(r, [(x["at"], x["size"], x["n"]) for x in f], total) for r, f in zip(runs, found)]
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    return apply


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """run, words: each different run of letters cut into words of ``counts``."""
    counts = written(counts, "word_counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    runs = runs.select("run").distinct()
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda at: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("run") - at + 1)), lambda size: F.struct(at.alias("at"), size.alias("size")))))
    parts = runs.select("run", F.explode(spans).alias("s")).select("run", F.expr("s.at - 1").alias("at"), F.col("s.size").alias("size"), F.expr("substring(run, s.at, s.size)").alias("word"))
    # A run has at most LABEL * LONGEST substrings, so a row holds what is known of one.
    known = parts.join(counts, "word").groupBy("run").agg(F.collect_list(F.struct("at", "size", "n")).alias("found"))
    rows = runs.join(known, "run", "left").select("run", F.coalesce("found", F.expr("cast(array() as array<struct<at:int,size:int,n:bigint>>)")).alias("found"))
    return rows.mapInArrow(_cutter(total), "run string, words array<string>")


_RUNS = r"[a-z]+|[^a-z.]+"
_TOKENS = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def _shape(token: Column) -> Column:
    """Numbers count by their length only."""
    return F.when(token.rlike(r"^[0-9]+$"), F.concat(F.lit("#"), F.length(token))).otherwise(token)


def host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, token, times: the words of each host; labels that are too long stay whole."""
    labels = hosts.select("host").distinct().select("host", F.explode(F.split("host", r"\.")).alias("label"))
    short = F.octet_length("label") <= LABEL
    runs = written(labels.select("host", F.explode(F.when(short, F.regexp_extract_all("label", F.lit(_RUNS), F.lit(0))).otherwise(F.array("label"))).alias("run"), short.alias("short")), "host_runs")
    letters = F.col("short") & F.col("run").rlike("^[a-z]+$")
    words = segmented(runs.where(letters), counts)
    cut_runs = runs.where(letters).groupBy("run", "host").agg(F.count("*").alias("times")).join(words, "run").select("host", F.explode("words").alias("token"), "times")
    others = runs.where(~letters & (F.col("run") != "")).select("host", _shape(F.col("run")).alias("token"), F.lit(1).cast("bigint").alias("times"))
    return cut_runs.unionByName(others).groupBy("host", F.concat(F.lit("host "), "token").alias("token")).agg(F.sum("times").alias("times"))


def path_tokens(path: Column) -> Column:
    found = F.regexp_extract_all(lower_ascii(path), F.lit(_TOKENS), F.lit(0))
    return F.transform(found, lambda t: F.concat(F.lit("path "), _shape(t)))


def bayes_weights(counted: DataFrame, labelled: dict[str, int]) -> tuple[DataFrame, int]:
    """(token, weight) and the prior: log ratios of block to allow in whole ``UNIT`` parts.

    ``counted``: token, verdict, times. ``labelled``: number of URLs by verdict. Add-one
    estimates; tokens that no rule's URL has carry no weight.
    """
    table = written(counted.groupBy("token").pivot("verdict", [ALLOW, BLOCK]).agg(F.sum("times")).fillna(0), "bayes_counts")
    a, b, size = table.agg(F.coalesce(F.sum(ALLOW), F.lit(0)), F.coalesce(F.sum(BLOCK), F.lit(0)), F.count("*")).first()
    n_allow, n_block = labelled.get(ALLOW, 0), labelled.get(BLOCK, 0)
    if not n_allow or not n_block:
        return table.select("token", F.lit(0).cast("bigint").alias("weight")), n_block - n_allow
    ratio = F.log((F.col(BLOCK) + 1) / F.lit(float(b + size))) - F.log((F.col(ALLOW) + 1) / F.lit(float(a + size)))
    return table.select("token", F.round(ratio * UNIT).cast("bigint").alias("weight")), round(math.log(n_block / n_allow) * UNIT)


def judge_urls(pages: DataFrame, words: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row of ``pages``.

    ``words``: (word, n), the unigram counts. The score is the log ratio of block to allow in
    ``UNIT`` parts, null where a rule decides; above 0 is blocked.
    """
    url = F.col(url_col).cast("string")
    split = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    split = split.select("*", rule.alias("rule"), verdict.alias("by_rule"), F.monotonically_increasing_id().alias("uid"))
    split = written(split, "urls")
    labelled = {r["by_rule"]: r["n"] for r in split.where(F.col("by_rule").isNotNull()).groupBy("by_rule").agg(F.count("*").alias("n")).collect()}
    by_host = written(split.groupBy("host", "by_rule").agg(F.count("*").alias("pages")), "hosts")
    tokens = written(host_tokens(by_host, words), "host_tokens")
    ruled = F.col("by_rule").isNotNull()
    from_hosts = by_host.where(ruled).join(tokens, "host").select("token", F.col("by_rule").alias("verdict"), (F.col("pages") * F.col("times")).alias("times"))
    from_paths = split.where(ruled).select(F.explode(path_tokens(F.col("path"))).alias("token"), F.col("by_rule").alias("verdict")).groupBy("token", "verdict").agg(F.count("*").alias("times"))
    weights, prior = bayes_weights(from_hosts.unionByName(from_paths), labelled)
    weights = written(weights, "bayes_weights")
    open_hosts = by_host.where(~ruled).select("host")
    host_scores = open_hosts.join(tokens, "host").join(weights, "token").groupBy("host").agg(F.sum(F.col("weight") * F.col("times")).alias("host_score"))
    asked = split.where(~ruled)
    path_scores = asked.select("uid", F.explode(path_tokens(F.col("path"))).alias("token")).join(weights, "token").groupBy("uid").agg(F.sum("weight").alias("path_score"))
    score = F.coalesce("host_score", F.lit(0)) + F.coalesce("path_score", F.lit(0)) + F.lit(prior)
    judged = asked.join(host_scores, "host", "left").join(path_scores, "uid", "left").withColumn("score", score.cast("bigint"))
    decided = split.where(ruled).withColumn("score", F.lit(None).cast("bigint"))
    columns = ["page_id", "host", "path", "rule"]
    verdict = F.coalesce("by_rule", F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW)).alias("verdict")
    return judged.select(*columns, verdict, "score").unionByName(decided.select(*columns, verdict, "score"))


def op13_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return judge_urls(pages.select("page_id", "url"), word_counts(pages.select("html"), "html"), RULES)


def _sql() -> str:
    ranked = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def case(result) -> str:
        tests = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{result(v, h, p)}'" for v, h, p in ranked]
        return f"CASE {' '.join(tests)} END"

    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    shape = "CASE WHEN regexp_full_match({0}, '[0-9]+') THEN '#' || length({0}) ELSE {0} END".format
    score = "best[w.e + 2 - size] + coalesce(ln(CAST(known[(w.e + 1 - size) * 100 + size] AS DOUBLE)), -size * ln(10)) - scale"
    return f"""
WITH RECURSIVE urls AS (
    SELECT page_id, row_number() OVER () AS uid, coalesce({low("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), ruled AS MATERIALIZED (
    SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS by_rule FROM urls
), counts AS MATERIALIZED (
    SELECT word, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all({low(f"regexp_replace(html, '{_MARKUP}', ' ', 'g')")}, '[a-z]+')) AS word FROM pages
    ) WHERE length(word) <= {LONGEST} GROUP BY word
), labels AS (SELECT host, unnest(string_split(host, '.')) AS label FROM (SELECT DISTINCT host FROM urls)),
runs AS MATERIALIZED (
    SELECT host, unnest(CASE WHEN strlen(label) <= {LABEL} THEN regexp_extract_all(label, '{_RUNS}') ELSE [label] END) AS run,
        strlen(label) <= {LABEL} AS short
    FROM labels
), letters AS (SELECT DISTINCT run FROM runs WHERE short AND regexp_full_match(run, '[a-z]+')),
spans AS (
    SELECT run, a, size, substr(run, a + 1, size) AS word
    FROM letters, unnest(range(length(run))) x(a), unnest(range(1, {LONGEST} + 1)) y(size) WHERE a + size <= length(run)
), tables AS MATERIALIZED (
    SELECT run, map_from_entries(list((a * 100 + size, n)) FILTER (n IS NOT NULL)) AS known,
        (SELECT ln(CAST(coalesce(sum(n), 0) + 1 AS DOUBLE)) FROM counts) AS scale
    FROM spans LEFT JOIN counts USING (word) GROUP BY run
), walk AS (
    SELECT run, 0 AS e, [CAST(0 AS DOUBLE)] AS best, CAST([] AS INTEGER[]) AS back FROM letters
    UNION ALL
    SELECT run, e + 1, list_append(best, list_max(scores)), list_append(back, CAST(list_position(scores, list_max(scores)) AS INTEGER))
    FROM (
        SELECT w.*, list_transform(range(1, least(w.e + 1, {LONGEST}) + 1), lambda size: {score}) AS scores
        FROM walk w JOIN tables USING (run) WHERE w.e < length(run)
    )
), cuts AS (
    SELECT run, back, length(run) AS e, CAST(NULL AS VARCHAR) AS word FROM walk WHERE e = length(run)
    UNION ALL
    SELECT run, back, e - back[e], substr(run, e - back[e] + 1, back[e]) FROM cuts WHERE e > 0
), host_tokens AS MATERIALIZED (
    SELECT host, token, count(*) AS times FROM (
        SELECT host, 'host ' || word AS token FROM runs JOIN (SELECT run, word FROM cuts WHERE word IS NOT NULL) USING (run) WHERE short
        UNION ALL
        SELECT host, 'host ' || {shape("run")} FROM runs
        WHERE NOT (short AND regexp_full_match(run, '[a-z]+')) AND run <> ''
    ) GROUP BY ALL
), path_tokens AS MATERIALIZED (
    SELECT uid, by_rule, 'path ' || {shape("t")} AS token
    FROM (SELECT uid, by_rule, unnest(regexp_extract_all({low("path")}, '{_TOKENS}')) AS t FROM ruled)
), counted AS (
    SELECT token, by_rule, times FROM ruled JOIN host_tokens USING (host) WHERE by_rule IS NOT NULL
    UNION ALL SELECT token, by_rule, 1 FROM path_tokens WHERE by_rule IS NOT NULL
), sides AS (
    SELECT token, coalesce(sum(times) FILTER (by_rule = 'allow'), 0) AS a, coalesce(sum(times) FILTER (by_rule = 'block'), 0) AS b FROM counted GROUP BY token
), totals AS (SELECT sum(a) + count(*) AS a, sum(b) + count(*) AS b FROM sides),
kinds AS (SELECT count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS b FROM ruled),
weights AS (
    SELECT token, CASE WHEN k.a = 0 OR k.b = 0 THEN 0 ELSE
        CAST(round((ln((s.b + 1) / CAST(t.b AS DOUBLE)) - ln((s.a + 1) / CAST(t.a AS DOUBLE))) * {UNIT}) AS BIGINT) END AS weight
    FROM sides s, totals t, kinds k
), prior AS (
    SELECT CASE WHEN a = 0 OR b = 0 THEN b - a ELSE CAST(round(ln(b / CAST(a AS DOUBLE)) * {UNIT}) AS BIGINT) END AS prior FROM kinds
), host_scores AS (SELECT host, sum(weight * times) AS s FROM host_tokens JOIN weights USING (token) GROUP BY host),
path_scores AS (SELECT uid, sum(weight) AS s FROM path_tokens JOIN weights USING (token) GROUP BY uid),
judged AS (
    SELECT r.*, CASE WHEN by_rule IS NULL THEN CAST(coalesce(h.s, 0) + coalesce(p.s, 0) + prior AS BIGINT) END AS score
    FROM ruled r CROSS JOIN prior LEFT JOIN host_scores h USING (host) LEFT JOIN path_scores p USING (uid)
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score FROM judged
"""


OP13_SQL = _sql()
