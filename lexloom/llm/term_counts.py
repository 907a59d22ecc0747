"""Problem 1: frequency of every distinct term or term sequence (suffix-sorted n-gram counting).

Every record's token sequence is cut into its suffixes of at most ``sigma`` tokens. Equal suffixes are
added up before the shuffle, routed by their first token, sorted in reverse lexicographic order, and read
once with a stack: a suffix closes the counts of all prefixes on the stack that it does not share. A
record counts once for a prefix however many of its suffixes begin with it: before routing, each suffix
says which of its prefixes are new in its record, so record sets become numbers that can be added.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.postings import RECORD
from lexloom.runtime import partitions

SEP = "\x01"


def record_suffixes(records: DataFrame, sigma: int) -> DataFrame:
    """``records(tokens array<string>)``, one row a record -> (suffix, weight, new array<long>).

    ``new[j]`` is 1 where the suffix is the first of its record with that prefix of j + 1 tokens.
    """
    texts, counts = "array<string>", "array<long>"
    every = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.slice("tokens", i, sigma))
    cut = records.where(F.size("tokens") > 0).select(F.array_sort(every).alias("s"))

    def marks(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at("s", F.greatest(i, F.lit(1)))).otherwise(F.array().cast(texts))
        return F.struct(x.alias("suffix"), F.transform(F.sequence(F.lit(1), F.size(x)), lambda j: (F.slice(x, 1, j) != F.slice(before, 1, j)).cast("long")).cast(counts).alias("new"))

    rows = cut.select(F.explode(F.transform("s", marks)).alias("r"))
    return rows.select(F.array_join("r.suffix", SEP).alias("suffix"), F.lit(1).cast("long").alias("weight"), "r.new")


def posting_suffixes(postings: DataFrame) -> DataFrame:
    """Suffixes of records known only as postings: without positions every suffix ends after its first
    term, and a posting stands for ``frequency`` of them, of which the first is new in its record."""
    return postings.select(F.col("term").alias("suffix"), F.col("frequency").cast("long").alias("weight"), F.array(F.lit(1).cast("long")).alias("new"))


def suffix_counts(suffixes: DataFrame, sigma: int) -> DataFrame:
    """(ngram, length, occurrences, records) of every prefix of the suffixes; tokens are joined by a blank.

    An empty table gives no rows. A first token that begins a third of all suffixes is routed together
    with the second, so it is spread over all tasks; its own count is added up afterwards.
    """
    parts = partitions(suffixes.sparkSession)
    added = suffixes.groupBy("suffix").agg(F.sum("weight").alias("weight"), *(F.sum(F.try_element_at("new", F.lit(j + 1))).alias(f"n{j}") for j in range(sigma)))
    head = F.substring_index("suffix", SEP, 2 if sigma > 1 else 1)
    routed = added.repartition(parts, F.xxhash64(head)).sortWithinPartitions(F.col("suffix").desc())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list] = []  # [token, occurrences, records], of the prefixes of the last suffix

        def close(down_to: int, out: list[tuple]) -> None:
            while len(stack) > down_to:
                _, n, r = stack[-1]
                out.append((SEP.join(s[0] for s in stack), len(stack), n, r))
                stack.pop()
                if stack:
                    stack[-1][1] += n

        for rows in batches:
            out: list[tuple] = []
            news = rows[[f"n{j}" for j in range(sigma)]].fillna(0).astype("int64").to_numpy().tolist()
            for suffix, weight, new in zip(rows.suffix.tolist(), rows.weight.tolist(), news, strict=True):
                tokens = suffix.split(SEP)
                same = 0
                while same < min(len(stack), len(tokens)) and stack[same][0] == tokens[same]:
                    same += 1
                close(same, out)
                stack.extend([t, 0, 0] for t in tokens[same:])
                stack[-1][1] += weight
                for s, k in zip(stack, new, strict=False):
                    s[2] += k
            yield pd.DataFrame(out, columns=["ngram", "length", "occurrences", "records"])
        out = []
        close(0, out)
        yield pd.DataFrame(out, columns=["ngram", "length", "occurrences", "records"])

    got = routed.mapInPandas(read, "ngram string, length int, occurrences long, records long")
    if sigma > 1:
        ones = got.where("length = 1").groupBy("ngram", "length").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        got = got.where("length > 1").unionByName(ones)
    return got.withColumn("ngram", F.translate("ngram", SEP, " "))


def mark_terms(counts: DataFrame, records: int, rare: int = 2, common: float = 0.3) -> DataFrame:
    """Adds ``record_share`` and ``mark``: ``rare`` in at most ``rare`` records, ``common`` in more than the
    share ``common`` of them, else ``useful``. A term that is both (tiny collections) is rare."""
    share = F.col("records") / F.lit(max(records, 1)).cast("double")
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * F.lit(records), "common").otherwise("useful")
    return counts.withColumn("record_share", share).withColumn("mark", mark)


def term_frequencies(postings: DataFrame) -> DataFrame:
    """(term, occurrences, records, record_share, mark) over ``current_postings``, which is read twice."""
    records = postings.select(*RECORD).distinct().count()
    counts = suffix_counts(posting_suffixes(postings), 1).select(F.col("ngram").alias("term"), "occurrences", "records")
    return mark_terms(counts, records)


def phrase_frequencies(texts: DataFrame, sigma: int = 3) -> DataFrame:
    """N-grams of up to ``sigma`` words of ``texts(text)``, one row a record: (ngram, length, occurrences,
    records, record_share, mark). Words are lower-cased runs of letters and digits; null and empty texts
    are records without words."""
    words = texts.select(F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1), F.array().cast("array<string>")).alias("tokens"))
    return mark_terms(suffix_counts(record_suffixes(words, sigma), sigma), texts.count())
