"""Problem 2: how distinctive a term is for its record (hypergeometric enrichment).

A record of ``length`` occurrences is a draw from all ``total`` occurrences of the collection, of which
``occurrences`` are of the term. The chance of at least ``frequency`` of them in the draw, adjusted for
the share of false discoveries over all postings, gives the score: its negative logarithm. Chances and
their order are worked out over the distinct (frequency, length, occurrences), which are far fewer than
the postings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.postings import RECORD
from lexloom.operators.scan import following_min, range_layout, running_sum
from lexloom.operators.skew import skew_join
from lexloom.runtime import materialize


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x >= 1: Stirling's series at x + 8, taken back by the product of the steps."""
    x = np.asarray(x, dtype=np.float64)
    low = x < 16
    y = np.where(low, x + 8, x)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    got = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series
    if low.any():
        steps = np.log(np.multiply.reduce([x[low] + k for k in range(8)]))
        got[low] -= steps
    return got


def beyond_stirling(n: np.ndarray) -> np.ndarray:
    """log n! less Stirling's leading terms (n + 1/2) log n - n + log(2 pi)/2, for n >= 1."""
    n = np.asarray(n, dtype=np.float64)
    z = 1 / (n * n)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / n
    low = n < 16
    if low.any():
        m = n[low]
        series[low] = log_gamma(m + 1) - ((m + 0.5) * np.log(m) - m + 0.5 * np.log(2 * np.pi))
    return series


def deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x without cancellation where both are near."""
    x, mean = np.asarray(x, dtype=np.float64), np.asarray(mean, dtype=np.float64)
    v = (x - mean) / (x + mean)
    got = x * np.log(x / mean) + mean - x
    near = np.abs(v) < 0.1
    if near.any():
        # log(x / mean) is twice the odd powers of v over their exponents.
        w, a, b = v[near], x[near], mean[near]
        powers = sum(w ** (2 * j + 1) / (2 * j + 1) for j in range(1, 9))
        got[near] = (a - b) * w + 2 * a * powers
    return got


def log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """log of the chance of ``x`` among ``n`` at ``p``, with ``q`` = 1 - p: the sum of log-gammas with the
    leading terms, which grow with n and cancel, taken out beforehand."""
    x, n, p, q = (np.asarray(a, dtype=np.float64) for a in np.broadcast_arrays(x, n, p, q))
    got = np.empty(x.shape)
    none, every = x == 0, (x == n) & (x > 0)
    inner = ~none & ~every
    with np.errstate(divide="ignore"):
        got[none] = np.where(n[none] == 0, 0.0, n[none] * np.where(p[none] < 0.5, np.log1p(-p[none]), np.log(q[none])))
        got[every] = n[every] * np.where(q[every] < 0.5, np.log1p(-q[every]), np.log(p[every]))
    a, m, s, t = x[inner], n[inner], p[inner], q[inner]
    b = m - a
    got[inner] = beyond_stirling(m) - beyond_stirling(a) - beyond_stirling(b) - deviance(a, m * s) - deviance(b, m * t) + 0.5 * (np.log(m) - np.log(a) - np.log(b) - np.log(2 * np.pi))
    return got


def log_upper_tail(k: np.ndarray, n: np.ndarray, marked: np.ndarray, total: float) -> np.ndarray:
    """log P(X >= k), X hypergeometric: n draws from ``total`` of which ``marked`` count. Exact: the terms
    from k up are added until they no longer change the sum. Where k <= the least possible count it is 0.

    The first term is the product of two binomial chances at p = n / total over a third, so that its error
    does not grow with ``total``."""
    k, n, m = (np.asarray(a, dtype=np.float64) for a in (k, n, marked))
    top = np.minimum(n, m)
    least = np.maximum(0.0, n - (total - m))
    start = np.minimum(np.maximum(k, least), top)
    p, q = n / total, (total - n) / total
    first = log_binomial(start, m, p, q) + log_binomial(n - start, total - m, p, q) - log_binomial(n, np.full_like(n, total), p, q)
    ratio_sum, term, i = np.ones_like(first), np.ones_like(first), start.copy()
    alive = i < top
    while alive.any():
        a = i[alive]
        step = (m[alive] - a) * (n[alive] - a) / ((a + 1) * (total - m[alive] - n[alive] + a + 1))
        term[alive] *= step
        ratio_sum[alive] += term[alive]
        i[alive] += 1
        alive &= (i < top) & ((term > ratio_sum * 1e-17) | (i < n * m / total))
    got = np.minimum(first + np.log(ratio_sum), 0.0)
    got[k <= least] = 0.0
    got[k > top] = -np.inf
    return got


def enrich(postings: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Every posting with its score: (kind, corpus, record_ix, term, frequency, length, occurrences,
    records, log_p, log_q, score, distinctive).

    ``postings`` is the materialized result of ``current_postings``. ``records`` is the number of records
    with the term, ``log_q`` the logarithm of the Benjamini-Hochberg adjusted probability, ``score`` its
    negative, ``distinctive`` whether it is at most ``alpha``. A record's length is the sum of its
    frequencies. An empty table gives no rows.
    """
    sums = postings.agg(F.count(F.lit(1)), F.sum("frequency")).first()
    rows, total = sums[0], float(sums[1] or 0)
    lengths = materialize(postings.groupBy(*RECORD).agg(F.sum("frequency").alias("length"), F.count(F.lit(1)).alias("_terms")), "lengths")
    terms = materialize(postings.groupBy("term").agg(F.sum("frequency").alias("occurrences"), F.count(F.lit(1)).alias("records")), "terms")

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(log_upper_tail(k.to_numpy(), n.to_numpy(), m.to_numpy(), total))

    case = ["frequency", "length", "occurrences"]
    sized = skew_join(postings, lengths, RECORD, rows=rows, size="_terms").drop("_terms")
    full = materialize(skew_join(materialize(sized, "sized"), terms, ["term"], rows=rows, size="records"), "cases")
    cases = full.groupBy(*case).agg(F.count(F.lit(1)).alias("_same"))
    scored = materialize(cases.withColumn("log_p", tail(*case)), "tails")
    order = ["log_p", *case]
    ranked = running_sum(range_layout(scored, [], order, ready=True), [], order, F.col("_same"), "_rank")
    raised = ranked.withColumn("_q", F.least(F.lit(0.0), F.col("log_p") + F.log(F.lit(float(max(rows, 1)))) - F.log(F.col("_rank").cast("double"))))
    adjusted = following_min(materialize(raised, "ranked"), [], order, F.col("_q"), "log_q").select(*case, "_same", "log_p", "log_q")
    got = skew_join(full, materialize(adjusted, "adjusted"), case, rows=rows, size="_same")
    got = got.withColumn("score", -F.col("log_q")).withColumn("distinctive", F.col("log_q") <= F.log(F.lit(float(alpha))))
    return got.select(*RECORD, "term", "frequency", "length", "occurrences", "records", "log_p", "log_q", "score", "distinctive")
