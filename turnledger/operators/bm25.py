"""BM25 over weighted memory fields, one index per scope (chat and branch)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.keys import fingerprint
from turnledger.functions.text import nfkc, tokenize
from turnledger.operators.ranking import positive_or, top_k
from turnledger.operators.scoring import B, K1, SCOPE, Best, add_up, ask, matched, term_weights
from turnledger.session import scratch_dir

DOC = [*SCOPE, "memory_id", "start_floor"]

# Field weights (the BM25 constants K1 and B are in ``scoring``).
FIELD_WEIGHTS = {"title": 3, "summary": 1, "tags": 2, "character_ids": 2, "plotline_ids": 2}
DEFAULT_TOP_K = 10
# Decimals of a score that count for its rank.
SCORE_DIGITS = 9

_SEP = "\x01"
_BY_DOC = ["memory_id", "start_floor"]


def _field_tokens(memories: DataFrame, dealt: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Active memories with one token array per field; all fields share one NFKC pass.

    ``dealt``: texts are dealt by these columns, so that a document's tokens are counted where they
    are made: a text is shuffled once instead of a row for each of its terms. A scope that is one
    constant is dropped from the keys of the count but not from the dealing, so it isn't among them.
    """
    keys = [*DOC, *(keep or [])]
    types = dict(memories.dtypes)
    parts = []
    for name in FIELD_WEIGHTS:
        if name not in types:
            value = F.lit("")
        elif types[name].startswith("array"):
            value = F.array_join(F.col(name), " ")
        else:
            value = F.col(name)
        parts.append(F.translate(F.coalesce(value, F.lit("")), _SEP, " "))
    text = memories.filter(~F.col("stale")).select(
        *keys, nfkc(F.concat_ws(_SEP, *parts)).alias("_text")
    )
    if dealt:
        text = text.repartition(*dealt)
    fields = F.split("_text", _SEP)
    return text.select(
        *keys, *[tokenize(fields[i], normalize=False).alias(n) for i, n in enumerate(FIELD_WEIGHTS)]
    )


def _length() -> Column:
    total = F.lit(0)
    for name, weight in FIELD_WEIGHTS.items():
        total = total + F.size(name) * F.lit(weight)
    return total.cast("int")


def _mark() -> Column:
    """One more occurrence in every copy of a document: that of no token."""
    return F.array(F.struct(F.lit(_SEP).alias("term"), F.lit(1).alias("weight")))


def _weighted(tokens: DataFrame, keep: list[str], *more: Column) -> DataFrame:
    """One row per token occurrence with its field weight; ``more`` are arrays of others."""

    def entries(name: str, weight: int) -> Column:
        return F.transform(
            F.col(name), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight"))
        )

    weighted = F.concat(*[entries(name, weight) for name, weight in FIELD_WEIGHTS.items()], *more)
    return tokens.select(*keep, F.explode(weighted).alias("_t")).select(
        *keep, F.col("_t.term").alias("term"), F.col("_t.weight").alias("weight")
    )


def weighted_terms(memories: DataFrame) -> DataFrame:
    """(document, term, tf): weighted term frequencies of every active memory."""
    tokens = _field_tokens(memories, _BY_DOC)
    return (
        _weighted(tokens, DOC).groupBy(*DOC, "term").agg(F.sum("weight").cast("int").alias("tf"))
    )


def document_lengths(memories: DataFrame) -> DataFrame:
    return _field_tokens(memories).select(*DOC, _length().alias("length"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """Documents and average length per scope; the average is never below one."""
    return lengths.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.greatest(F.avg("length"), F.lit(1.0)).alias("avg_length"),
    )


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy(*SCOPE, "term").agg(F.count(F.lit(1)).alias("df"))


def build_index(memories: DataFrame, written: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings ``(document, length, term, tf)`` and document lengths, ready to be written.

    ``written`` writes a table and reads it back: both then come from one pass over the texts.
    """
    if written is not None:
        return split_index(written(index_rows(memories)))
    postings = index_rows(memories, marks=False)
    return postings, document_lengths(memories)


def index_rows(memories: DataFrame, dealt: list[str] | None = None, keep: list[str] | None = None, marks: bool = True) -> DataFrame:
    """Postings, also by the columns ``keep`` of a document; with ``marks`` each document has a row
    of the term ``_SEP``, which is no token, with the number of its copies as ``tf``."""
    tokens = _field_tokens(memories, dealt or _BY_DOC, keep).withColumn("length", _length())
    keys = [*DOC, *(keep or []), "length"]
    return (
        _weighted(tokens, keys, *([_mark()] if marks else []))
        .groupBy(*keys, "term")
        .agg(F.sum("weight").cast("int").alias("tf"))
    )


def split_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and document lengths from rows with marks."""
    copies = rows.where(F.col("term") == _SEP).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("tf"))))
    return rows.where(F.col("term") != _SEP), copies.select(*DOC, "length")


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of each query ``(scope, query_id, text)``."""
    return queries.select(
        *SCOPE, "query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")
    )


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder: made once, and the planner knows its size."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score(postings: DataFrame, stats: DataFrame, terms: DataFrame, best: list[Best] | None = None) -> DataFrame:
    """Score of every (query, document) pair that shares a term; with ``best`` of those pairs
    only that can be in one of its lists.

    The terms of the queries go to all tasks, and the asked postings of a document to one, which
    adds up its scores: postings are shuffled once, with all of a document's in one row, and
    pairs never are. What is left for ``best`` is written, as several lists are read from it.
    """
    made = None
    for asked in ask(terms):
        found = matched(postings, asked)
        frequency = found.groupBy(*SCOPE, "_t").agg(F.count(F.lit(1)).alias("df"))
        weights = term_weights(frequency, stats, asked)
        rows = add_up(found, asked, weights, ["memory_id", "start_floor"], "tf", "length", best)
        rows = rows.select(*SCOPE, "query_id", "memory_id", "start_floor", "score")
        made = rows if made is None else made.unionByName(rows)
    return made if best is None else staged(made, "scored")


def by_score(column: str = "score", digits: int | None = SCORE_DIGITS) -> list[Column]:
    """Best first; ties by earliest floor, then id. Sums of the same parts in another order are a tie;
    without ``digits`` the scores are compared as they are."""
    best = F.col(column) if digits is None else F.round(column, digits)
    return [F.desc(best), F.asc("start_floor"), F.asc("memory_id")]


def search_index(
    postings: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K
) -> DataFrame:
    k = positive_or(k, DEFAULT_TOP_K)
    scored = score(postings, corpus_stats(lengths), query_terms(queries), [Best(k)])
    return top_k(scored, [*SCOPE, "query_id"], by_score(), k)


def bm25_topk(memories: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Top-k memories per query without a stored index.

    Only tokens that some query asks for survive the first join, so the shuffle
    carries matching postings, never the text. They are written, so texts are read once; each
    copy of a document counts ``_SEP``, which is no token, so that its length comes with them.
    """
    k = positive_or(k, DEFAULT_TOP_K)
    terms = query_terms(queries)
    tokens = _field_tokens(memories).withColumn("length", _length())
    wanted = terms.select(*SCOPE, "term").unionByName(queries.select(*SCOPE, F.lit(_SEP).alias("term"))).distinct()
    found = staged(
        _weighted(tokens, [*DOC, "length"], _mark())
        .join(wanted, [*SCOPE, "term"], "left_semi")
        .groupBy(*DOC, "length", "term")
        .agg(F.sum("weight").cast("int").alias("tf")),
        "matched",
    )
    postings, lengths = split_index(found)
    scored = score(postings, corpus_stats(lengths), terms, [Best(k)])
    return top_k(scored, [*SCOPE, "query_id"], by_score(), k)


def memory_fingerprint() -> Column:
    """Key of everything the index reads from a memory row."""
    fields = ["memory_id", "title", "summary", "tags", "character_ids", "plotline_ids"]
    return fingerprint(F.to_json(F.struct(*fields)))


def index_changes(memories: DataFrame, indexed: DataFrame) -> DataFrame:
    """What the index must do per memory: ``upsert``, ``remove`` or ``keep``.

    ``indexed`` holds ``(scope, memory_id, content_key)`` of the documents in the index.
    """
    keys = [*SCOPE, "memory_id"]
    active = memories.filter(~F.col("stale")).select(*keys, memory_fingerprint().alias("_new"))
    known = indexed.select(*keys, F.col("content_key").alias("_old"))
    action = (
        F.when(F.col("_new").isNull(), "remove")
        .when(F.col("_old").isNull() | (F.col("_old") != F.col("_new")), "upsert")
        .otherwise("keep")
    )
    return active.join(known, keys, "full_outer").select(
        *keys, action.alias("action"), F.coalesce("_new", "_old").alias("content_key")
    )


def refresh_index(
    memories: DataFrame, postings: DataFrame, lengths: DataFrame, changes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Next postings and lengths: kept rows as stored, changed documents tokenised anew."""
    keys = [*SCOPE, "memory_id"]
    kept = changes.filter("action = 'keep'").select(*keys)
    changed = changes.filter("action = 'upsert'").select(*keys)
    new_postings, new_lengths = build_index(memories.join(changed, keys, "left_semi"))
    return (
        postings.join(kept, keys, "left_semi").unionByName(new_postings),
        lengths.join(kept, keys, "left_semi").unionByName(new_lengths),
    )
