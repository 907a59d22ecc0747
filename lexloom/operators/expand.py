"""Query terms against the dictionary: exact, prefix and typo expansion for batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import Analyzer, analyze_token, opens_prefix, tokens

# What a match by expansion weighs against an exact one, and the default budget a term.
EXACT, PREFIX, FUZZY1, FUZZY2, BUDGET = 1.0, 0.85, 0.7, 0.5, 16


def query_terms(queries: DataFrame, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """(query_id, source_ix, source, prefix): the analysed words of ``queries(query_id, text)`` in order,
    repeated ones included; the last of a text that ends in a letter or digit is a prefix."""
    words = queries.select("query_id", tokens(F.col("text")).alias("_w"), opens_prefix(F.col("text")).alias("_open"))
    each = words.select("query_id", "_open", F.size("_w").alias("_n"), F.posexplode("_w").alias("_at", "_raw"))
    got = each.withColumn("source", analyze_token(F.col("_raw"), analyzer)).where(F.length("source") > 1)
    return got.select("query_id", F.col("_at").alias("source_ix"), "source", (F.col("_open") & (F.col("_at") == F.col("_n") - 1)).alias("prefix"))


def expand(terms: DataFrame, dictionary: DataFrame, corpora: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(query_id, corpus, source_ix, source, prefix, term, df, kind, distance, boost, ord).

    ``corpora(query_id, corpus)`` says where each query looks. A word's own term comes first; the last
    word's continuations by document frequency, then term; typos only where there is neither, within one
    change from four letters on and two from eight, same first letter, nearest first. A budget of 0 keeps
    exact terms only. Prefixes and typos are equi-joins on distinct words (on the prefix of that length;
    on first letter and length), so no pair of unrelated words is ever made.
    """
    words = terms.select("source", "prefix").distinct()
    exact = words.select("source").distinct().join(dictionary.withColumnRenamed("term", "source"), "source").select("corpus", "source", F.col("source").alias("term"), "df", F.lit("exact").alias("kind"), F.lit(0).alias("distance"))
    found = exact
    if budget > 0:
        has = exact.select("corpus", "source", F.lit(True).alias("_exact"))
        grow = words.where("prefix").select("source").distinct()
        # Distinct lengths below that of the longest term: a number of lengths, not of words.
        longest = dictionary.agg(F.max(F.length("term"))).first()[0] or 0
        sizes = sorted(r[0] for r in grow.select(F.length("source").alias("n")).where(F.col("n") < longest).distinct().collect())
        cuts = F.filter(F.array(*[F.lit(s) for s in sizes]).cast("array<int>"), lambda s: s < F.length("term"))
        stems = dictionary.select("corpus", "term", "df", F.explode(cuts).alias("_s")).withColumn("source", F.expr("left(term, _s)"))
        longer = stems.join(grow, "source").join(has, ["corpus", "source"], "left")
        by_df = Window.partitionBy("corpus", "source").orderBy(F.desc("df"), "term")
        room = F.lit(budget) - F.coalesce(F.col("_exact").cast("int"), F.lit(0))
        prefixed = longer.withColumn("_r", F.row_number().over(by_df)).where(F.col("_r") <= room).select("corpus", "source", "term", "df", F.lit("prefix").alias("kind"), F.lit(0).alias("distance"))
        # Typos: for words as such (no exact term), and for last words (neither exact nor continued).
        reach = F.when(F.length("source") >= 8, 2).when(F.length("source") >= 4, 1).otherwise(0)
        asked = terms.join(corpora, "query_id").select("corpus", "source", "prefix").distinct().withColumn("_k", reach).where("_k > 0")
        asked = asked.join(has, ["corpus", "source"], "left_anti")
        grown = prefixed.select("corpus", "source").distinct().withColumn("prefix", F.lit(True))
        asked = asked.join(grown, ["corpus", "source", "prefix"], "left_anti")
        spread = asked.select("corpus", "source", "prefix", "_k", F.substring("source", 1, 1).alias("_f"), F.explode(F.sequence(F.length("source") - F.col("_k"), F.length("source") + F.col("_k"))).alias("_l"))
        near = dictionary.select("corpus", "term", "df", F.substring("term", 1, 1).alias("_f"), F.length("term").alias("_l")).join(spread, ["corpus", "_f", "_l"])
        near = near.withColumn("distance", F.when(F.col("_k") == 2, F.levenshtein("source", "term", 2)).otherwise(F.levenshtein("source", "term", 1))).where("distance >= 1")
        nearest = Window.partitionBy("corpus", "source", "prefix").orderBy("distance", F.desc("df"), "term")
        fuzzy = near.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= budget).select("corpus", "source", "prefix", "term", "df", F.lit("fuzzy").alias("kind"), "distance")
        found = exact.withColumn("prefix", F.lit(None).cast("boolean")).unionByName(prefixed.withColumn("prefix", F.lit(True))).unionByName(fuzzy)
    else:
        found = found.withColumn("prefix", F.lit(None).cast("boolean"))
    found = found.withColumnRenamed("prefix", "_for")
    joined = terms.join(corpora, "query_id").join(found, ["corpus", "source"]).where(F.col("_for").isNull() | (F.col("_for") == F.col("prefix")))
    boost = F.when(F.col("kind") == "exact", EXACT).when(F.col("kind") == "prefix", PREFIX).when(F.col("distance") == 1, FUZZY1).otherwise(FUZZY2)
    order = Window.partitionBy("query_id", "corpus", "source_ix").orderBy(F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "prefix", 1).otherwise(2), "distance", F.desc("df"), "term")
    return joined.select("query_id", "corpus", "source_ix", "source", "prefix", "term", "df", "kind", F.when(F.col("kind") == "fuzzy", F.col("distance")).alias("distance"), boost.alias("boost"), F.row_number().over(order).alias("ord"))

