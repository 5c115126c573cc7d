"""Joins and ordered scans that stay parallel when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 16
# Rows of one key that a single task orders at most: the order column is an integer that
# is unique in its key, so a block of this width cannot hold more.
DEFAULT_BLOCK = 1 << 17


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread: list[Column],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Join whose big side may hold most of its rows under one key.

    The big side is spread over ``salts`` sub-keys by hashing ``spread``; the small side
    is repeated once per salt. Every pair still meets exactly once. Supports joins that
    keep the big side's rows or pairs: inner, left, left_semi, left_anti.
    """
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_small = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt")


def _blocks(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Adds ``_block``: a key of at most ``size`` rows is one block, however sparse its order is; a
    longer one is cut by its order. The list of the longer ones is broadcast: it has at most
    rows / ``size`` entries."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_many")).filter(F.col("_many") > size)
    block = F.when(F.col("_many").isNull(), F.lit(0)).otherwise(F.floor(F.col(order) / F.lit(size)))
    return df.join(F.broadcast(many), keys, "left").withColumn("_block", block.cast("long")).drop("_many")


def ordinal(
    df: DataFrame, keys: list[str], order: str, out: str = "ordinal", size: int = DEFAULT_BLOCK
) -> DataFrame:
    """1-based position of each row in its key by ``order`` (integer, unique per key).

    Two levels: rows are numbered inside blocks of the order column, and each block
    starts after the rows counted in the blocks before it.
    """
    blocks = _blocks(df, keys, order, size)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocks.withColumn(out, F.row_number().over(inside))
        .join(starts, [*keys, "_block"])
        .withColumn(out, (F.col(out) + F.col("_start")).cast("long"))
        .drop("_block", "_start")
    )


def previous_row(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: dict[str, str],
    size: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Columns of the row just before, as ``{output name: column}``; null on the first row."""
    blocks = _blocks(df, keys, order, size)
    carried = F.struct(*[F.col(c).alias(o) for o, c in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block")
    tails = (
        blocks.groupBy(*keys, "_block")
        .agg(F.max_by(carried, F.col(order)).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(earlier))
        .drop("_tail")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    joined = (
        blocks.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_prev", F.lag(carried).over(inside))
        .join(tails, [*keys, "_block"])
        .withColumn("_prev", F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
    )
    return joined.select(*df.columns, *[F.col("_prev")[o].alias(o) for o in columns])


def last_known(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    out: str,
    size: int = DEFAULT_BLOCK,
    backward: bool = False,
) -> DataFrame:
    """Last non-null ``value`` at or before each row; ``backward`` looks at or after."""
    blocks = _blocks(df, keys, order, size)
    pick = F.min_by if backward else F.max_by
    known = F.when(F.col(value).isNotNull(), F.col(order))
    step = F.desc if backward else F.asc
    earlier = (
        Window.partitionBy(*keys).orderBy(step("_block")).rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = (
        blocks.groupBy(*keys, "_block")
        .agg(pick(F.col(value), known).alias("_tail"))
        .withColumn("_carry", F.last("_tail", ignorenulls=True).over(earlier))
        .drop("_tail")
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(step(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        blocks.withColumn(out, F.last(value, ignorenulls=True).over(inside))
        .join(carries, [*keys, "_block"])
        .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
        .drop("_block", "_carry")
    )


def running_xor(
    df: DataFrame, keys: list[str], order: str, columns: list[str], size: int = DEFAULT_BLOCK
) -> DataFrame:
    """Columns replaced by the XOR of themselves over all rows up to each row."""
    blocks = _blocks(df, keys, order, size)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        blocks.groupBy(*keys, "_block")
        .agg(*[F.bit_xor(c).alias(f"_t_{c}") for c in columns])
        .select(
            *keys,
            "_block",
            *[F.coalesce(F.bit_xor(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_c_{c}") for c in columns],
        )
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = blocks.select(
        *[c for c in blocks.columns if c not in columns],
        *[F.bit_xor(c).over(inside).alias(c) for c in columns],
    )
    joined = summed.join(carries, [*keys, "_block"])
    return joined.select(
        *[
            F.col(c).bitwiseXOR(F.col(f"_c_{c}")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def last_before(
    points: DataFrame,
    rows: DataFrame,
    keys: list[str],
    at: str,
    order: str,
    columns: dict[str, str],
    size: int = DEFAULT_BLOCK,
) -> DataFrame:
    """As-of join: for each point the last row whose ``order`` is smaller than ``at``.

    Points and rows are merged into one ordered line per key, so a key with many points
    and many rows costs their sum, not their product. A null ``at`` is after everything.
    """
    position = F.coalesce(F.col(at).cast("long"), F.lit(1 << 60)) * 2
    carried = F.struct(*[F.col(c).alias(o) for o, c in columns.items()])
    marks = rows.select(*keys, (F.col(order).cast("long") * 2 + 1).alias("_pos"), carried.alias("_row"))
    asked = points.withColumn("_pos", position)
    probes = asked.select(*keys, "_pos").distinct()
    line = probes.withColumn("_row", F.lit(None).cast(marks.schema["_row"].dataType))
    found = last_known(line.unionByName(marks), keys, "_pos", "_row", "_last", size)
    hits = found.filter("_row is null").select(*keys, "_pos", "_last")
    return asked.join(hits, [*keys, "_pos"], "left").select(
        *points.columns, *[F.col("_last")[o].alias(o) for o in columns]
    )
