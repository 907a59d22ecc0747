"""Running aggregates over ordered groups of any size.

A window partitioned by a hot key sorts that whole key in one task. Here rows are range-partitioned by
key and order together, each range is scanned by itself, and the totals of the ranges before (or after)
it are added. Only a range that continues a group begun elsewhere needs such a carry, so there are at
most as many carries as ranges, which bounds what is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.runtime import materialize, partitions

PID = "_range"


def range_layout(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None, ready: bool = False) -> DataFrame:
    """``df`` with its range number in ``_range``; ``keys + order`` must order the rows totally.

    The ranges' bounds are sampled before the rows are spread, so ``df`` is read twice; it is written as a
    table first, unless it is ``ready``: a table itself, or as cheap as one."""
    n = ranges or partitions(df.sparkSession)
    cols = [F.col(c) for c in [*keys, *order]]
    df = df if ready else materialize(df, "unranged")
    return materialize(df.repartitionByRange(n, *cols).withColumn(PID, F.spark_partition_id()), "ranges")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[PID] == right["_r"], *(left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys)])


def running_sum(laid: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group up to and including this one.

    ``laid`` comes from ``range_layout`` with the same keys and order. Null values count as 0; a null key
    is a group of its own; an empty table stays empty.
    """
    value = F.coalesce(value, F.lit(0))
    totals = laid.groupBy(PID, *keys).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_c", F.sum("_t").over(before)).where(F.col("_c").isNotNull())
    carry = carry.select(F.col(PID).alias("_r"), "_c", *(F.col(k).alias(f"_k_{k}") for k in keys))
    local = Window.partitionBy(PID, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = laid.withColumn(out, F.sum(value).over(local))
    got = got.join(F.broadcast(carry), _same(got, carry, keys), "left")
    return got.withColumn(out, F.col(out) + F.coalesce(F.col("_c"), F.lit(0))).drop("_c", "_r", *(f"_k_{k}" for k in keys))


def following_min(laid: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the least ``value`` of the group from this row on."""
    totals = laid.groupBy(PID, *keys).agg(F.min(value).alias("_t"))
    after = Window.partitionBy(*keys).orderBy(F.col(PID).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_c", F.min("_t").over(after)).where(F.col("_c").isNotNull())
    carry = carry.select(F.col(PID).alias("_r"), "_c", *(F.col(k).alias(f"_k_{k}") for k in keys))
    # Backwards with a growing frame: Spark takes quadratic time over frames that shrink.
    local = Window.partitionBy(PID, *keys).orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    got = laid.withColumn(out, F.min(value).over(local))
    got = got.join(F.broadcast(carry), _same(got, carry, keys), "left")
    return got.withColumn(out, F.least(F.col(out), F.col("_c"))).drop("_c", "_r", *(f"_k_{k}" for k in keys))
