"""The posting tables of both formats as one table of current postings (shared by problems 1 and 2)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = ["kind", "corpus", "record_ix"]


def fold(term: str) -> str:
    """NFKD without combining marks, lower case, trimmed."""
    return "".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c)).lower().strip()


def folded(term: Column) -> Column:
    """``fold`` of a column. Plain ASCII is folded by Spark; only other terms are worked on in Python. It counts
    as nondeterministic, which it is not, so that a filter on the result does not repeat the work."""

    @F.pandas_udf("string")
    def rest(terms: pd.Series) -> pd.Series:
        seen = {t: fold(t) for t in terms.dropna().unique()}
        return pd.Series([seen.get(t) for t in terms], dtype=object)

    ascii_only = term.rlike(r"^[\x20-\x7e]*$")
    return F.when(ascii_only, F.trim(F.lower(term))).otherwise(rest.asNondeterministic()(F.when(~ascii_only, term)))


def current_postings(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """(kind, corpus, record_ix, term, frequency): one row per record and folded term.

    ``v1(corpus, term, document_index, term_frequency, ingested_at)``, ``v2(corpus, term, chunk,
    frequencies, ingested_at)``; kind is ``v1`` or ``v2``. Of rows with the same record and folded term
    the one that arrived last counts (at equal arrival the larger frequency, a null arrival first).
    Missing lists, null frequencies and null elements are 0; a posting that adds up to 0 or less does not
    exist. Rows without corpus, record or term, and terms that fold to nothing, are left out.
    """
    one = v1.select(F.lit("v1").alias("kind"), "corpus", F.col("document_index").alias("record_ix"), "term", F.coalesce(F.col("term_frequency").cast("long"), F.lit(0)).alias("frequency"), "ingested_at")
    added = F.aggregate(F.coalesce("frequencies", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    two = v2.select(F.lit("v2").alias("kind"), "corpus", F.col("chunk").alias("record_ix"), "term", added.alias("frequency"), "ingested_at")
    rows = one.unionByName(two).where("corpus IS NOT NULL AND record_ix IS NOT NULL AND term IS NOT NULL")
    rows = rows.withColumn("term", folded(F.col("term"))).where("term <> ''")
    last = rows.groupBy(*RECORD, "term").agg(F.max(F.struct("ingested_at", "frequency")).alias("last"))
    return last.select(*RECORD, "term", F.col("last.frequency").alias("frequency")).where("frequency > 0")
