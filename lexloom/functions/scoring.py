"""Ranking and vector formulas as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
FIELDS = ("title", "heading", "body")
WEIGHTS = {"title": 2.0, "heading": 1.5, "body": 1.0}


def idf(count: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (count - df + 0.5) / (df + 0.5))


def bm25(tf: Column, df: Column, length: Column, average: Column, count: Column) -> Column:
    """Unfielded BM25; an average length under 1 counts as 1."""
    return idf(count, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(average, F.lit(1.0))))


def weighted(prefix: str, weights: dict[str, float]) -> Column:
    """Sum over the fields of weight times ``{prefix}_{field}``."""
    return reduce(lambda a, b: a + b, [F.lit(float(weights[f])) * F.col(f"{prefix}_{f}").cast("double") for f in FIELDS])


def bm25f(df: Column, count: Column, weights: dict[str, float], boost: Column) -> Column:
    """Fielded BM25 over columns tf_*, len_*, avg_*: one saturation of the weighted sum."""
    tf, average = weighted("tf", weights), F.greatest(weighted("avg", weights), F.lit(1.0))
    return idf(count, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * weighted("len", weights) / average)) * boost


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _let(value: Column, body) -> Column:
    """Binds a value to a lambda variable, so that it is made once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is 0. Of int8 vectors the scale has no effect."""
    return _let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def l2_normalize(v: Column) -> Column:
    return _let(norm(v), lambda n: F.transform(v, lambda x: (x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0))).cast("float")))


def quantize_scale(v: Column) -> Column:
    top = F.array_max(F.transform(v, lambda x: F.abs(x).cast("double")))
    return F.when(top > 0, top).otherwise(F.lit(1.0)) / 127


def quantize(v: Column, scale: Column) -> Column:
    """int8 values, halves rounded up, within 127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / scale + 0.5))).cast("tinyint"))


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: (x * scale).cast("float"))


def semantic(cos: Column) -> Column:
    return (cos + 1) / 2


def blend(lexical: Column, sem: Column, weight: float) -> Column:
    """Weighted mean of the normalised lexical score and the semantic one; without vector the lexical."""
    w = min(1.0, max(0.0, weight))
    return F.when(sem.isNull(), lexical).otherwise(lexical * (1 - w) + sem * w)
