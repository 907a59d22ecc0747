"""Ranking quality over a run and judgments, regression gates, percentiles, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE, SANITY = 0.01, 0.15


def _joined(run: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judged queries, and the run's rows of them with their relevance (unjudged: 0)."""
    judged = qrels.groupBy("query_id").agg(F.count(F.when(F.col("rel") > 0, 1)).alias("relevant"))
    rows = run.join(judged.select("query_id"), "query_id", "left_semi").join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left")
    return judged, rows.withColumn("rel", F.coalesce("rel", F.lit(0)))


def _gain(rel: Column, rank: Column) -> Column:
    return rel / F.log2(rank + 1)


def graded_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, ap, recall, precision, rr) at ``k`` for every judged query.

    ``run(query_id, rank, doc_id)``, rank from 1; ``qrels(query_id, doc_id, rel)``. Gains are linear; a
    judgment above 0 is relevant; average precision divides by all relevant documents and precision by
    ``k``. A query that the run lacks has zeros; where nothing is relevant ndcg, ap and recall are null.
    Judged documents that the run lacks count in the ideal order. Unjudged queries are left out.
    """
    judged, rows = _joined(run.where(F.col("rank") <= k), qrels)
    ideal = qrels.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))).where(F.col("r") <= k)
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("rel") > 0, _gain(F.col("rel"), F.col("r"))).otherwise(0.0)).alias("ideal"))
    hit = (F.col("rel") > 0).cast("int")
    upto = F.sum(hit).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    got = rows.withColumn("hits", upto).groupBy("query_id").agg(
        F.sum(F.when(F.col("rel") > 0, _gain(F.col("rel"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(hit).alias("found"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"),
    )
    all_rows = judged.join(ideal, "query_id").join(got, "query_id", "left").na.fill(0, ["dcg", "precisions", "found"])
    some = F.col("relevant") > 0
    return all_rows.select(
        "query_id",
        F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).alias("ndcg"),
        F.when(some, F.col("precisions") / F.col("relevant")).alias("ap"),
        F.when(some, F.col("found") / F.col("relevant")).alias("recall"),
        (F.col("found") / F.lit(k)).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def binary_metrics(run: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, rr, ndcg) at ``k`` with binary judgments ``(query_id, doc_id)``: repeated hits of
    a document count once, at the first place; without relevant documents all are 0."""
    rel = judgments.select("query_id", "doc_id").distinct()
    wanted = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = run.where(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).join(rel, ["query_id", "doc_id"])
    got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("h"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    rows = wanted.join(got, "query_id", "left").na.fill(0, ["h", "dcg"])
    return rows.select("query_id", (F.col("h") / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("dcg") / best).alias("ndcg"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over queries; a null counts as 0 and in the number. No queries give zeros."""
    names = [c for c in metrics.columns if c != "query_id"]
    return metrics.agg(F.count(F.lit(1)).alias("queries"), *[F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)).alias(c) for c in names])


def macro(results: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """By engine: the mean of each metric over datasets, and milliseconds a query weighted by queries.

    ``results(dataset, engine, queries, query_ms, completed, metrics...)``; what did not complete counts
    in the metrics but not in the latency, which is null if nothing completed.
    """
    done = F.col("completed")
    ms = F.try_divide(F.sum(F.when(done, F.col("query_ms"))), F.sum(F.when(done, F.col("queries"))))
    return results.groupBy("engine").agg(F.count(F.lit(1)).alias("datasets"), *[F.avg(n).alias(n) for n in names], ms.alias("ms_per_query"))


def latency_percentiles(timings: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    """Nearest-rank p50 and p95 by group."""
    p = lambda f: F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY {value})")
    return timings.groupBy(*by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


def dedup_ranked(run: DataFrame, limit: int = 100) -> DataFrame:
    """A run with each document at its first place only, ranked anew and cut at ``limit``."""
    first = run.groupBy("query_id", "doc_id").agg(F.min("rank").alias("r"))
    by = Window.partitionBy("query_id").orderBy("r", "doc_id")
    return first.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id")


def require_unique(run: DataFrame) -> DataFrame:
    """The run; an error if a query names a document twice."""
    twice = run.groupBy("query_id", "doc_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"query {twice[0].query_id} names document {twice[0].doc_id} twice")
    return run


def compare_runs(before: DataFrame, after: DataFrame, metrics: tuple[str, ...] = ("ndcg", "recall", "rr"), tolerance: float = TOLERANCE) -> DataFrame:
    """(candidate, mode, each metric's change, passed): every row of ``before``; a candidate that ``after``
    lacks has zeros there. It passes unless ndcg falls by more than the tolerance."""
    new = after.select("candidate", "mode", *[F.col(m).alias(f"new_{m}") for m in metrics])
    rows = before.join(new, ["candidate", "mode"], "left")
    change = {m: F.coalesce(F.col(f"new_{m}"), F.lit(0.0)) - F.col(m) for m in metrics}
    return rows.select("candidate", "mode", *[c.alias(f"{m}_change") for m, c in change.items()], (change["ndcg"] >= -tolerance).alias("passed"))


def gates(results: DataFrame, accepted: DataFrame, references: DataFrame, own: str, tolerance: float = 0.02, sanity: float = SANITY) -> DataFrame:
    """(dataset, engine, kind, actual, minimum) of the results that fail.

    ``results(dataset, engine, ndcg, completed)``; the engine ``own`` must be there and complete for every
    dataset of ``references(dataset, reference)`` and stay within ``sanity`` of it; every engine of
    ``accepted(dataset, engine, accepted)`` within ``tolerance`` of what was accepted.
    """
    mine = references.join(results.where(F.col("engine") == own), "dataset", "left")
    missing = mine.where(~F.coalesce("completed", F.lit(False))).select("dataset", F.lit(own).alias("engine"), F.lit("missing").alias("kind"), F.lit(None).cast("double").alias("actual"), F.lit(None).cast("double").alias("minimum"))
    low = mine.where(F.col("completed") & (F.col("ndcg") < F.col("reference") - sanity)).select("dataset", F.lit(own).alias("engine"), F.lit("sanity").alias("kind"), F.col("ndcg").alias("actual"), (F.col("reference") - sanity).alias("minimum"))
    worse = results.join(accepted, ["dataset", "engine"]).where(F.col("ndcg") < F.col("accepted") - tolerance).select("dataset", "engine", F.lit("regression").alias("kind"), F.col("ndcg").alias("actual"), (F.col("accepted") - tolerance).alias("minimum"))
    return missing.unionByName(low).unionByName(worse)


def salient_terms(chunks: DataFrame, least: int = 4) -> DataFrame:
    """(corpus, chunk_ix, term, salience): of every chunk the rarest content term that its title and heading
    lack, of equal ones the first by name."""
    from lexloom.functions.text import index_text, tokenize

    total = chunks.groupBy("corpus").agg(F.count(F.lit(1)).alias("_n"))
    every = chunks.select("corpus", "chunk_ix", F.explode(F.array_distinct(tokenize(index_text(F.col("title"), F.col("heading"), F.col("content"))))).alias("term"))
    df = every.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))
    head = tokenize(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("heading", F.lit(""))))
    own = chunks.select("corpus", "chunk_ix", F.explode(F.filter(F.array_distinct(F.array_except(tokenize(F.col("content")), head)), lambda t: F.length(t) >= least)).alias("term"))
    scored = own.join(df, ["corpus", "term"]).join(F.broadcast(total), "corpus").withColumn("salience", F.log(1 + F.col("_n") / F.col("df")))
    best = scored.groupBy("corpus", "chunk_ix").agg(F.min(F.struct((-F.col("salience")).alias("s"), "term")).alias("b"))
    return best.select("corpus", "chunk_ix", "b.term", (-F.col("b.s")).alias("salience"))


def text_table(rows: list[dict], columns: list[str]) -> str:
    """A small collected table as aligned text."""
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    cells = [columns, *[[show(r.get(c)) for c in columns] for r in rows]]
    width = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in cells)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows]])
