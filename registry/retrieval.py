"""Tokens, BM25, vectors, fusion, rerank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.base import (
    MEMORIES_SQL,
    SEARCHES_SQL,
    VECTORS_SQL,
    kept,
    memories,
    query,
    searches,
    table,
    vectors,
)
from turnledger.functions.keys import fingerprint, vector_space_fingerprint
from turnledger.functions.parse import canonical_base_url
from turnledger.functions.text import estimate_tokens, tokenize
from turnledger.operators import blockmax, bm25, fusion, pivots
from turnledger.operators import vectors as vec
from turnledger.operators.floors import SCOPE


def _tokens(text: str) -> str:
    """SQL of the token list of a text expression."""
    runs = rf"regexp_extract_all(lower({text}), '\p{{Han}}+|[\p{{L}}\p{{N}}]+')"
    chars = r"regexp_extract_all(r, '\p{Han}')"
    pairs = f"list_transform(range(1, len({chars})), lambda i: {chars}[i] || {chars}[i + 1])"
    return (
        f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^\\p{{Han}}') "
        f"THEN list_concat({chars}, {pairs}) ELSE [r] END))"
    )


# Documents with their number spelled in Han digits, so that both token kinds occur.
_HAN = "translate(CAST(doc_id AS VARCHAR), '0123456789', '零一二三四五六七八九')"


@query(
    "tokenize_text",
    f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct,
       sha256(array_to_string(t, ' ')) AS tokens_key
FROM (SELECT doc_id, {_tokens(f"{_HAN} || ' ' || text || 'x' || {_HAN}")} AS t FROM documents)""",
)
def tokenize_text(spark: SparkSession, sf: str) -> DataFrame:
    han = F.translate(F.col("doc_id").cast("string"), "0123456789", "零一二三四五六七八九")
    text = F.concat(han, F.lit(" "), F.col("text"), F.lit("x"), han)
    return (
        table(spark, sf, "documents")
        .select("doc_id", tokenize(text).alias("t"))
        .select(
            "doc_id",
            F.size("t").alias("n_tokens"),
            F.size(F.array_distinct("t")).alias("n_distinct"),
            F.sha2(F.array_join("t", " "), 256).alias("tokens_key"),
        )
    )


_TERMS_SQL = f"""
WITH {MEMORIES_SQL},
occ AS (
  SELECT chat_id, branch_id, memory_id, start_floor, unnest({_tokens("coalesce(title, '')")}) AS term, 3 AS weight FROM memories WHERE NOT stale
  UNION ALL SELECT chat_id, branch_id, memory_id, start_floor, unnest({_tokens("summary")}), 1 FROM memories WHERE NOT stale
  UNION ALL SELECT chat_id, branch_id, memory_id, start_floor, unnest({_tokens("array_to_string(tags, ' ')")}), 2 FROM memories WHERE NOT stale
  UNION ALL SELECT chat_id, branch_id, memory_id, start_floor, unnest({_tokens("array_to_string(character_ids, ' ')")}), 2 FROM memories WHERE NOT stale
  UNION ALL SELECT chat_id, branch_id, memory_id, start_floor, unnest({_tokens("array_to_string(plotline_ids, ' ')")}), 2 FROM memories WHERE NOT stale
),
terms AS (
  SELECT chat_id, branch_id, memory_id, start_floor, term, CAST(sum(weight) AS INTEGER) AS tf
  FROM occ GROUP BY ALL
)"""

_STATS_SQL = (
    _TERMS_SQL
    + """,
lengths AS (
  SELECT m.chat_id, m.branch_id, m.memory_id, m.start_floor, coalesce(t.length, 0) AS length
  FROM memories m LEFT JOIN (SELECT memory_id, sum(tf) AS length FROM terms GROUP BY 1) t USING (memory_id)
  WHERE NOT m.stale
),
stats AS (
  SELECT chat_id, branch_id, count(*) AS doc_count, greatest(avg(length), 1.0) AS avg_length
  FROM lengths GROUP BY ALL
)"""
)

_SCORES_SQL = (
    _STATS_SQL
    + f""",
{SEARCHES_SQL},
qterms AS (
  SELECT DISTINCT chat_id, branch_id, query_id, unnest({_tokens("text")}) AS term FROM searches
),
freq AS (SELECT chat_id, branch_id, term, count(*) AS df FROM terms GROUP BY ALL),
scored AS (
  SELECT q.chat_id, q.branch_id, q.query_id, t.memory_id, t.start_floor,
         sum(ln(1 + (s.doc_count - f.df + 0.5) / (f.df + 0.5))
             * (t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.length / s.avg_length)))) AS score
  FROM qterms q
  JOIN terms t ON t.branch_id = q.branch_id AND t.term = q.term
  JOIN freq f ON f.branch_id = q.branch_id AND f.term = q.term
  JOIN stats s ON s.branch_id = q.branch_id
  JOIN lengths l ON l.memory_id = t.memory_id
  GROUP BY ALL
),
bm25 AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id, branch_id, query_id
    ORDER BY round(score, 9) DESC, start_floor, memory_id) AS rank
  FROM scored QUALIFY rank <= 10
)"""
)


@query("weighted_term_frequencies", _TERMS_SQL + " SELECT * FROM terms")
def weighted_term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.weighted_terms(memories(spark, sf))


@query(
    "bm25_corpus_stats",
    _STATS_SQL + " SELECT chat_id, branch_id, doc_count, round(avg_length, 6) AS avg_length FROM stats",
)
def bm25_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = bm25.corpus_stats(bm25.document_lengths(memories(spark, sf)))
    return stats.withColumn("avg_length", F.round("avg_length", 6))


@query(
    "bm25_document_frequency",
    _TERMS_SQL + " SELECT chat_id, branch_id, term, count(*) AS df FROM terms GROUP BY ALL",
)
def bm25_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.document_frequency(bm25.weighted_terms(memories(spark, sf)))


_BM25_OUT = " SELECT chat_id, branch_id, query_id, rank, memory_id, round(score, 6) AS score FROM bm25"


def _ranked(df: DataFrame) -> DataFrame:
    return df.select(*SCOPE, "query_id", "rank", "memory_id", F.round("score", 6).alias("score"))


@query("bm25_topk", _SCORES_SQL + _BM25_OUT)
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(bm25.bm25_topk(memories(spark, sf), searches(spark, sf)))


@query("bm25_indexed_topk", _SCORES_SQL + _BM25_OUT)
def bm25_indexed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Same answer through the index tables (postings and lengths)."""
    postings, lengths = _index(spark, sf)
    return _ranked(bm25.search_index(postings, lengths, searches(spark, sf)))


@query("bm25_blockmax_topk", _SCORES_SQL + _BM25_OUT)
def bm25_blockmax_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Same answer from the blocks whose bounds reach a query's threshold."""
    written = lambda rows: kept(spark, sf, "block_postings", lambda s, d: rows)
    postings, lengths = blockmax.build_blocks(memories(spark, sf), written=written)
    blocks = kept(spark, sf, "blocks", lambda s, d: blockmax.block_maxima(postings))
    return _ranked(blockmax.block_max_topk(postings, blocks, lengths, searches(spark, sf)))


def _index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return bm25.build_index(memories(spark, sf), lambda rows: kept(spark, sf, "postings", lambda s, d: rows))


# A later state of the memories: some edited, some withdrawn, some new to the index.
_SYNC_SQL = f"""
WITH {MEMORIES_SQL},
indexed AS (SELECT * FROM memories WHERE NOT stale AND CAST(memory_id AS BIGINT) % 9 <> 4),
later AS (
  SELECT * REPLACE (CASE WHEN CAST(memory_id AS BIGINT) % 8 = 3 THEN summary || ' edited' ELSE summary END AS summary,
                    stale OR CAST(memory_id AS BIGINT) % 13 = 2 AS stale)
  FROM memories
)"""


def _later(df: DataFrame) -> DataFrame:
    doc = F.col("memory_id").cast("bigint")
    return df.withColumn(
        "summary",
        F.when(doc % 8 == 3, F.concat("summary", F.lit(" edited"))).otherwise(F.col("summary")),
    ).withColumn("stale", F.col("stale") | (doc % 13 == 2))


@query(
    "index_sync_changes",
    _SYNC_SQL
    + """
SELECT coalesce(n.branch_id, o.branch_id) AS branch_id, coalesce(n.memory_id, o.memory_id) AS memory_id,
       CASE WHEN n.memory_id IS NULL THEN 'remove' WHEN o.memory_id IS NULL OR n.summary <> o.summary THEN 'upsert' ELSE 'keep' END AS action
FROM (SELECT * FROM later WHERE NOT stale) n FULL OUTER JOIN indexed o ON n.memory_id = o.memory_id""",
)
def index_sync_changes(spark: SparkSession, sf: str) -> DataFrame:
    base = memories(spark, sf)
    indexed = base.filter("not stale and cast(memory_id as bigint) % 9 <> 4").select(
        *SCOPE, "memory_id", bm25.memory_fingerprint().alias("content_key")
    )
    changes = bm25.index_changes(_later(base), indexed)
    return changes.select("branch_id", "memory_id", "action")


@query(
    "embedding_text",
    f"""
WITH {MEMORIES_SQL}
SELECT memory_id, 'sha256:' || sha256(trim(
  coalesce(title, '') || ' ' || summary || ' ' || array_to_string(character_ids, ' ') || ' ' || array_to_string(tags, ' '),
  chr(9) || chr(10) || chr(13) || ' ')) AS content_fingerprint
FROM memories""",
)
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).select(
        "memory_id", fingerprint(vec.embedding_text()).alias("content_fingerprint")
    )


# Each vector asks in the scope of the next label, so queries and stored vectors differ.
_VQ_SQL = f"""
WITH {VECTORS_SQL},
vq AS (
  SELECT 'vecs' AS chat_id, 'label:' || ((label + 1) % 10) AS branch_id, CAST(vec_id AS VARCHAR) AS query_id,
         CAST(embedding AS DOUBLE[]) AS vector
  FROM embeddings
),
vscores AS (
  SELECT q.chat_id, q.branch_id, q.query_id, v.memory_id, v.start_floor,
         round(list_cosine_similarity(q.vector, v.vector), 12) AS score
  FROM vq q JOIN vectors v ON v.branch_id = q.branch_id
),
vtop AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id, branch_id, query_id
    ORDER BY score DESC, start_floor, memory_id) AS rank
  FROM vscores WHERE score > 0 QUALIFY rank <= 10
)"""


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit("vecs").alias("chat_id"),
        F.concat(F.lit("label:"), ((F.col("label") + 1) % 10).cast("string")).alias("branch_id"),
        F.col("vec_id").cast("string").alias("query_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


@query(
    "vector_topk",
    _VQ_SQL + " SELECT chat_id, branch_id, query_id, rank, memory_id, round(score, 6) AS score FROM vtop",
)
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(vec.vector_topk(vectors(spark, sf), _vector_queries(spark, sf)))


@query(
    "vector_pruned_topk",
    _VQ_SQL + " SELECT chat_id, branch_id, query_id, rank, memory_id, round(score, 6) AS score FROM vtop",
)
def vector_pruned_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Same answer from the clusters whose bounds reach a query's threshold."""
    chosen = kept(spark, sf, "pivots", lambda s, d: pivots.choose_pivots(vectors(s, d)))
    rows = kept(spark, sf, "clustered", lambda s, d: pivots.clustered(vectors(s, d), chosen))
    clusters = kept(spark, sf, "clusters", lambda s, d: pivots.cluster_bounds(rows))
    return _ranked(pivots.pruned_topk(rows, clusters, chosen, _vector_queries(spark, sf)))


@query(
    "cosine_similarity",
    """
SELECT a.vec_id, round(CASE WHEN a.vec_id % 50 = 0 THEN 0.0
  ELSE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) END, 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring vectors; every fiftieth is cut short to show the unequal-length rule."""
    rows = table(spark, sf, "embeddings")
    short = F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 5)).otherwise(
        F.col("embedding")
    )
    left = rows.select("vec_id", short.alias("a"))
    right = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return left.join(right, "vec_id").select(
        "vec_id", F.round(vec.cosine(F.col("a"), F.col("b")), 6).alias("cosine")
    )


_PLAN_SQL = f"""
WITH {MEMORIES_SQL},
texts AS (
  SELECT *, 'sha256:' || sha256(trim(coalesce(title, '') || ' ' || summary || ' ' || array_to_string(character_ids, ' ') || ' ' || array_to_string(tags, ' '),
    chr(9) || chr(10) || chr(13) || ' ')) AS cf FROM memories
),
acts AS (
  SELECT chat_id, branch_id, memory_id,
    CASE WHEN stale THEN 'remove'
         WHEN CAST(memory_id AS BIGINT) % 5 IN (0, 1) THEN 'keep'
         WHEN CAST(memory_id AS BIGINT) % 10 = 2 THEN 'cooldown' ELSE 'embed' END AS action
  FROM texts WHERE NOT (stale AND CAST(memory_id AS BIGINT) % 5 = 4)
)"""


@query("embedding_sync_plan", _PLAN_SQL + " SELECT * FROM acts")
def embedding_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _sync_plan(spark, sf).select(*SCOPE, "memory_id", "action")


@query(
    "embedding_sync_counts",
    _PLAN_SQL
    + """
SELECT chat_id, branch_id, count(*) FILTER (action = 'keep') AS keep, count(*) FILTER (action = 'embed') AS embed,
       count(*) FILTER (action = 'cooldown') AS cooldown, count(*) FILTER (action = 'remove') AS remove
FROM acts GROUP BY ALL""",
)
def embedding_sync_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vec.plan_counts(_sync_plan(spark, sf))


def _sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Stored: two in five current, others of an old text, another space, or missing."""
    base = memories(spark, sf)
    doc = F.col("memory_id").cast("bigint")
    key = fingerprint(vec.embedding_text())
    refs = base.filter(doc % 5 != 4).select(
        *SCOPE,
        "memory_id",
        F.when(doc % 5 == 2, fingerprint(F.lit("old"))).otherwise(key).alias("content_fingerprint"),
        F.when(doc % 5 == 3, "space-a").otherwise("space-b").alias("binding_fingerprint"),
    )
    failures = base.filter("not stale").filter(doc % 10 == 2).select(
        *SCOPE,
        "memory_id",
        key.alias("content_fingerprint"),
        F.lit("2026-01-01 00:01:00").cast("timestamp").alias("retry_at"),
    )
    return vec.embedding_plan(
        base, refs, "space-b", failures, F.lit("2026-01-01").cast("timestamp")
    )


@query(
    "embedding_scan",
    """
SELECT CAST(vec_id AS VARCHAR) AS memory_id, len(embedding) AS dim
FROM embeddings WHERE vec_id % 7 NOT IN (3, 5) AND vec_id % 4 <> 1""",
)
def embedding_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Stored vectors as JSON text; some are malformed, some hold nulls, some lost their memory."""
    rows = table(spark, sf, "embeddings")
    text = (
        F.when(F.col("vec_id") % 7 == 3, F.lit("[0.1, oops"))
        .when(F.col("vec_id") % 7 == 5, F.lit("[0.1, null]"))
        .otherwise(F.to_json("embedding"))
    )
    refs = rows.select(F.col("vec_id").cast("string").alias("memory_id"), text.alias("vector_json"))
    known = vectors(spark, sf).filter("start_floor % 4 <> 1")
    return vec.parse_vectors(refs, known).select("memory_id", F.size("vector").alias("dim"))


@query(
    "vector_space_fingerprint",
    """
SELECT page_id, 'sha256:' || sha256('{"apiType":"openai","baseUrl":"' || CASE WHEN page_id % 9 = 4 THEN 'ftp://' || page_id ELSE regexp_extract(url, '^https?://[^/?#]+')
  || CASE WHEN regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) IN ('', '/') THEN '/v1'
          ELSE rtrim(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1), '/') END END
  || '","headers":[{"name":"x-page","value":"' || page_id || '"},{"name":"x-team","value":"a"}],"model":"m' || (page_id % 3) || '"}') AS space_key
FROM pages""",
)
def vector_space(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    headers = F.create_map(
        F.lit(" X-Team"), F.lit("a"), F.lit("Authorization"), page, F.lit("X-Page "), page
    )
    model = F.concat(F.lit("m"), (F.col("page_id") % 3).cast("string"))
    # An address that is no HTTP URL still tells its space from others.
    url = F.when(F.col("page_id") % 9 == 4, F.concat(F.lit(" ftp://"), page)).otherwise(F.col("url"))
    key = vector_space_fingerprint(
        F.lit("openai"), canonical_base_url(url), headers, model, url
    )
    return table(spark, sf, "pages").select("page_id", key.alias("space_key"))


# Two ranked lists per query over the same memories: BM25 and a label-based order.
_FUSED_SQL = (
    _SCORES_SQL
    + """,
second AS (
  SELECT chat_id, branch_id, query_id, memory_id, start_floor,
         row_number() OVER (PARTITION BY chat_id, branch_id, query_id ORDER BY start_floor, memory_id) AS rank
  FROM scored WHERE start_floor % 3 = 1 QUALIFY rank <= 10
),
ranked AS (
  SELECT chat_id, branch_id, query_id, memory_id, start_floor, 'bm25' AS source, rank FROM bm25
  UNION ALL SELECT chat_id, branch_id, query_id, memory_id, start_floor, 'embedding', rank FROM second
),
fused AS (
  SELECT chat_id, branch_id, query_id, memory_id, start_floor, sum(1.0 / (60 + rank)) AS rrf_score,
         max(CASE WHEN source = 'bm25' THEN rank END) AS bm25_rank,
         max(CASE WHEN source = 'embedding' THEN rank END) AS embedding_rank
  FROM ranked GROUP BY ALL
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id, branch_id, query_id
    ORDER BY round(rrf_score, 12) DESC, start_floor, memory_id) AS rrf_rank
  FROM fused
)"""
)


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    asked = searches(spark, sf)
    postings, lengths = _index(spark, sf)
    lists = [bm25.Best(10), bm25.Best(10, by_floor=True, only="start_floor % 3 = 1")]
    scored = bm25.score(postings, bm25.corpus_stats(lengths), bm25.query_terms(asked), lists)
    keys = [*SCOPE, "query_id"]
    first = bm25.top_k(scored, keys, bm25.by_score(), 10)
    order = [F.asc("start_floor"), F.asc("memory_id")]
    second = bm25.top_k(scored.filter("start_floor % 3 = 1"), keys, order, 10)
    return fusion.fuse({"bm25": first, "embedding": second})


@query(
    "reciprocal_rank_fusion",
    _FUSED_SQL
    + """
SELECT chat_id, branch_id, query_id, memory_id, round(rrf_score, 6) AS rrf_score, bm25_rank, embedding_rank, rrf_rank
FROM ordered""",
)
def reciprocal_rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    ranked = fusion.rank_fused(_fused(spark, sf), 20)
    return ranked.select(
        *SCOPE,
        "query_id",
        "memory_id",
        F.round("rrf_score", 6).alias("rrf_score"),
        F.try_element_at("ranks", F.lit("bm25")).alias("bm25_rank"),
        F.try_element_at("ranks", F.lit("embedding")).alias("embedding_rank"),
        "rrf_rank",
    )


_RERANK_SQL = (
    _FUSED_SQL
    + """,
pool AS (
  SELECT o.*, l.quality AS rerank_score,
         least(count(*) OVER (PARTITION BY o.chat_id, o.branch_id, o.query_id), 12) AS pool_size
  FROM ordered o LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = o.memory_id
),
final AS (
  SELECT chat_id, branch_id, query_id, memory_id,
         CASE WHEN pool_size <= 6 THEN 'skipped_within_final' ELSE 'applied' END AS rerank_status,
         row_number() OVER (PARTITION BY chat_id, branch_id, query_id
           ORDER BY CASE WHEN pool_size <= 6 THEN 0 ELSE coalesce(rerank_score, -1e9) END DESC,
                    round(rrf_score, 12) DESC, start_floor, memory_id) AS rank
  FROM pool WHERE pool_size <= 6 OR rrf_rank <= 12
  QUALIFY rank <= 6
)"""
)


def _final(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "recalled", _select_final)


def _select_final(spark: SparkSession, sf: str) -> DataFrame:
    fused = _fused(spark, sf)
    quality = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("memory_id"),
        F.col("quality").cast("double").alias("rerank_score"),
    )
    scores = fused.select(*SCOPE, "query_id", "memory_id").join(quality, "memory_id")
    return fusion.select_final(fused, scores, enabled=True, candidates=12, final=6)


@query(
    "rerank_and_recall",
    _RERANK_SQL + " SELECT chat_id, branch_id, query_id, rank, memory_id, rerank_status FROM final",
)
def rerank_and_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _select_final(spark, sf).select(*SCOPE, "query_id", "rank", "memory_id", "rerank_status")


@query(
    "rerank_response_scores",
    """
SELECT doc_id AS query_id, i AS index, CAST(quality AS DOUBLE) + i AS relevance_score
FROM (SELECT doc_id, quality, unnest([0, 1, 2]) AS i FROM labels)
WHERE NOT (doc_id % 5 = 0 AND i = 1)""",
)
def rerank_response_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Responses in the three known layouts, with out-of-range and non-numeric rows."""
    doc, q = F.col("doc_id"), F.col("quality")

    def item(index: str, score: str, i: int, bad: bool = False) -> F.Column:
        value = (q + i).cast("string")
        value = F.when((doc % 5 == 0) & F.lit(bad), F.lit('"n/a"')).otherwise(value)
        return F.concat(F.lit(f'{{"{index}":{i},"{score}":'), value, F.lit("}"))

    def items(index: str, score: str) -> F.Column:
        listed = [item(index, score, 0), item(index, score, 1, True), item(index, score, 2), item(index, score, 3)]
        return F.concat(F.lit("["), F.concat_ws(",", *listed), F.lit("]"))

    response = (
        F.when(doc % 3 == 0, F.concat(F.lit('{"results":'), items("index", "relevance_score"), F.lit("}")))
        .when(doc % 3 == 1, F.concat(F.lit('{"data":{"results":'), items("document_index", "score"), F.lit("}}")))
        .otherwise(F.concat(F.lit('{"data":'), items("documentIndex", "rerank_score"), F.lit("}")))
    )
    rows = table(spark, sf, "labels").select(
        doc.alias("query_id"), response.alias("response"), F.lit(3).alias("document_count")
    )
    return fusion.rerank_scores(rows)


@query(
    "token_estimate",
    r"""
SELECT doc_id, CAST(CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1,
  length(regexp_replace(t, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g'))
  + ceil((length(t) - length(regexp_replace(t, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g'))) / 4.0)) END AS INTEGER) AS tokens
FROM (SELECT doc_id, text || translate(CAST(doc_id AS VARCHAR), '0123456789', '零一二三かなカナ한국') AS t FROM documents)""",
)
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        "text", F.translate(F.col("doc_id").cast("string"), "0123456789", "零一二三かなカナ한국")
    )
    return table(spark, sf, "documents").select("doc_id", estimate_tokens(text).alias("tokens"))
