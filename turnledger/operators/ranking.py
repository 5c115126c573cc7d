"""Top-k and latest-per-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positive_or(value: int | None, default: int) -> int:
    return value if isinstance(value, int) and value > 0 else default


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Rows ranked 1..k per key.

    The planner turns the filter into a group limit before the shuffle, so at most k
    rows per key leave each task, however many rows one key owns.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` columns.

    Written as an aggregate, so copies of one key are reduced before the shuffle. Columns
    of the order are not carried a second time where they are all there is.
    """
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in order])
    if set(rest) <= set(order):
        return df.groupBy(*keys).agg(F.max(by).alias("_row")).select(
            *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns]
        )
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), by).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )
