"""Joins of a large table with a unique-keyed one where a single key may hold a third of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import partitions


def skew_join(big: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None, size: str | None = None) -> DataFrame:
    """Joins ``big`` with ``unique`` (one row a key) on ``keys``; ``how`` is inner or left.

    Keys above ``rows / partitions`` rows are looked up by broadcast: fewer than ``partitions`` keys can
    exceed that share, so their number is bounded whatever the data. All others are joined by shuffle.
    ``size`` names the column of ``unique`` that holds the rows of a key in ``big``, where that is known;
    ``big`` is then not counted. ``big`` should be materialized, since both kinds of keys read it.
    Columns of ``unique`` besides the keys must not occur in ``big``. Null keys match nothing.
    """
    parts = partitions(big.sparkSession)
    if size is None:
        rows = big.count() if rows is None else rows
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    else:
        counts = unique.select(*keys, F.col(size).alias("_n"))
        rows = counts.agg(F.sum("_n")).first()[0] or 0 if rows is None else rows
    least = max(1, rows // parts)
    hot = [r for r in counts.where(F.col("_n") > least).drop("_n").collect() if all(v is not None for v in r)]
    if not hot:
        return big.join(unique, keys, how)
    marks = F.broadcast(big.sparkSession.createDataFrame(hot, big.select(*keys).schema).withColumn("_hot", F.lit(True)))
    marked = big.join(marks, keys, "left")
    few = unique.join(marks, keys, "left_semi")
    out = [marked.where("_hot IS NULL").drop("_hot").join(unique, keys, how), marked.where("_hot").drop("_hot").join(F.broadcast(few), keys, how)]
    return reduce(DataFrame.unionByName, out)
