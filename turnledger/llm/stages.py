"""Written intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from turnledger.session import scratch_dir

#: Rows of whole texts that cross to Python at once. Both sides hold a batch several times over.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most ``rows`` rows in this session; a smaller setting is kept. A task's
    memory outside the heap then no longer depends on the default of 10 000 texts."""
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH, str(rows))


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The table written to the shared folder and read again: its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
