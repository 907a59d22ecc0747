"""Runs candidate configurations over judged queries: a build, a search in every mode, and their quality."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators.evaluate import binary_metrics, mean_metrics
from lexloom.operators.index import Index
from lexloom.operators.search import Options, search
from lexloom.runtime import materialize

HIT = ["query_id", "rank", "id", "document_id", "title", "url", "score", "lexical_score", "semantic_score"]


@dataclass(frozen=True)
class Candidate:
    """What a candidate changes: settings of the corpus it is built from, and search options."""

    corpus: Mapping[str, Any] = field(default_factory=dict)
    query: Mapping[str, Any] = field(default_factory=dict)


def hits_of(page: DataFrame) -> DataFrame:
    """The columns of a result page that a run keeps."""
    return page.select(*HIT)


def relevance_keys(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """``hits`` with ``doc_id``: a chunk's own id where that is judged for the query, else its document's."""
    judged = judgments.select("query_id", F.col("doc_id").alias("id"), F.lit(True).alias("_own")).distinct()
    return hits.join(judged, ["query_id", "id"], "left").withColumn("doc_id", F.when(F.col("_own"), F.col("id")).otherwise(F.col("document_id"))).drop("_own")


def first_relevant(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """(query_id, first): the rank of the first hit that is judged by itself or by its document; null without."""
    wanted = judgments.select("query_id", F.col("doc_id").alias("_j")).distinct()
    both = hits.select("query_id", "rank", F.explode(F.array_distinct(F.array("id", "document_id"))).alias("_j"))
    found = both.join(wanted, ["query_id", "_j"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return judgments.select("query_id").distinct().join(found, "query_id", "left")


def evaluate_search(index: Index, queries: DataFrame, judgments: DataFrame, options: Options, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Quality of one mode, one row (queries, recall, rr, ndcg), and its hits (``HIT`` and ``doc_id``).

    ``judgments(query_id, doc_id)`` may name chunks or documents; a query without any is not counted.
    """
    hits = materialize(relevance_keys(hits_of(search(index, queries, replace(options, limit=k, offset=0))), judgments), "hits")
    return mean_metrics(binary_metrics(hits, judgments, k)), hits


def run_candidates(spark: SparkSession, candidates: Mapping[str, Candidate], index_of: Callable[[Candidate], tuple[Index, tuple[str, ...]]], queries: DataFrame, judgments: DataFrame, k: int = 10) -> tuple[dict, DataFrame]:
    """A run over all candidates, and the hits of every candidate and mode.

    ``index_of`` builds a candidate's index and names the modes it can be searched in. No candidates at all
    is one with defaults. The run has, by candidate and mode, the quality and the milliseconds a query of
    the batch; queries are a batch, so the median and the 95 % point are the same. No judgments are an error.
    """
    if judgments.isEmpty():
        raise ValueError("the query set is empty")
    results, every = [], None
    for name, candidate in (candidates or {"default": Candidate()}).items():
        began = time.time()
        index, modes = index_of(candidate)
        built = time.time() - began
        for mode in modes:
            began = time.time()
            quality, hits = evaluate_search(index, queries, judgments, Options(**{**candidate.query, "mode": mode}), k)
            q = quality.first()
            spent = (time.time() - began) * 1000 / max(1, q.queries)
            results.append({"candidate": name, "mode": mode, "recall": q.recall, "rr": q.rr, "ndcg": q.ndcg, "p50": spent, "p95": spent, "build_seconds": built})
            own = hits.select(F.lit(name).alias("candidate"), F.lit(mode).alias("mode"), *HIT)
            every = own if every is None else every.unionByName(own)
    return {"version": 1, "name": "run", "created_at": "", "environment": {"spark": spark.version}, "k": k, "results": results}, every


def load_more(index: Index, queries: DataFrame, options: Options, shown: int) -> tuple[DataFrame, Column]:
    """The page after the ``shown`` results a reader has, and whether more follow it."""
    page = search(index, queries, replace(options, offset=max(0, shown)))
    return page, F.max("rank").over(Window.partitionBy("query_id")) < F.col("total")
