"""Exact dedup against a persistent digest index, in DataFrame and SQL functions only.

The index is a table bucketed and sorted by the SHA-256 digest. A new batch is grouped by
digest, meets the index in a sort-merge anti-join on the bucketing key (the index is not
shuffled), and the digests that are new are appended.

Defined cases: a null text is an empty text; rows without id are kept only where no row of
the group has an id; rows repeated with their id are one document and share its decision;
an empty batch appends nothing; other columns pass through ``with_decisions`` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.stages import fresh_path

_FIELDS = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch_id STRING"


def text_sha256(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def create_index(spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None) -> str:
    """An empty index table; ``buckets`` grows with the data it is made for."""
    name = name or f"digest_index_{uuid.uuid4().hex}"
    path = path or fresh_path(spark, "digest_index")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(
        f"CREATE TABLE {name} ({_FIELDS}) USING parquet LOCATION '{path}' "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
    )
    return name


def append_batch(docs: DataFrame, index: str, batch_id: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Add the digests of ``docs`` that the index lacks, each with the largest id.

    A batch that is in the index already adds nothing, so a failed driver may run it again.
    """
    spark = docs.sparkSession
    table = spark.table(index)
    if table.filter(F.col("batch_id") == batch_id).limit(1).count():
        return
    groups = (
        docs.select(F.unhex(text_sha256(text_col)).alias("digest"), F.col(id_col).cast("bigint").alias("_id"))
        .groupBy("digest")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    fresh = groups.join(table.select("digest").hint("merge"), "digest", "left_anti")
    fresh.withColumn("batch_id", F.lit(batch_id)).write.insertInto(index)


def with_decisions(docs: DataFrame, index: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with _keep_id, _group_size, _kept and _text_sha256.

    The index side is joined by the hexadecimal digest, so both sides are shuffled and a
    group that holds much of the data is split by the engine's skew handling.
    """
    known = docs.sparkSession.table(index).select(
        F.lower(F.hex("digest")).alias("_text_sha256"),
        F.col("keep_id").alias("_keep_id"),
        F.col("group_size").alias("_group_size"),
    )
    return (
        docs.withColumn("_text_sha256", text_sha256(text_col))
        .join(known, "_text_sha256", "left")
        .withColumn("_kept", F.col(id_col).cast("bigint").eqNullSafe(F.col("_keep_id")))
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each text, also where a row
    is repeated with its id."""
    index = create_index(docs.sparkSession)
    append_batch(docs, index, "all", id_col, text_col)
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kept = with_decisions(boxed, index, "_id", "_text").filter("_kept")
    return kept.dropDuplicates(["_text_sha256"]).select("_row.*")


def op6_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = create_index(spark)
    append_batch(docs, index, "documents")
    return with_decisions(docs, index).select(
        "doc_id",
        F.col("_keep_id").alias("keep_id"),
        F.col("_group_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_text_sha256").alias("text_sha256"),
    )


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
