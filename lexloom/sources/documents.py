"""Document sources: files, rendered HTML, rows in memory, named adapters; judgments, qrels, runs."""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import glob_regex, route_of_html
from lexloom.sources import html
from lexloom.sources.store import write_text

DOCUMENT = "id string, url string, title string, content string, metadata map<string,string>"
SECTION = "id string, url string, title string, metadata map<string,string>, section_ix int, heading string, section string"

_adapters: dict[str, Callable[..., DataFrame]] = {}


def define_source(name: str, load: Callable[..., DataFrame]) -> None:
    """A named adapter: ``load(spark, **options)`` returns documents."""
    _adapters[name] = load


def load_documents(spark: SparkSession, source, **options) -> DataFrame:
    """Documents of a DataFrame, rows in memory, a path, a callable, or a named adapter (``@name``).

    No source at all reads rendered HTML below ``root``."""
    if isinstance(source, DataFrame):
        return source
    if callable(source):
        return source(spark, **options)
    if isinstance(source, str) and source.startswith("@"):
        return _adapters[source[1:]](spark, **options)
    if isinstance(source, str):
        return filesystem(spark, source)
    if source is None:
        return generated_html(spark, options["root"])
    return in_memory(spark, source)


def in_memory(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    names = [f.name for f in T._parse_datatype_string(DOCUMENT).fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], DOCUMENT)


def _relative(df: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/").split("://", 1)[-1]
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9+.-]+:/*", "/")
    return df.withColumn("relative", F.url_decode(F.replace(F.regexp_replace(path, "^/*" + _quote(base.lstrip("/")) + "/?", ""), F.lit("+"), F.lit("%2B"))))


def _quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def filesystem(spark: SparkSession, root: str, pattern: str = "**/*.{md,mdx,html}") -> DataFrame:
    """Files below a folder whose relative path fits a glob (``**`` crosses folders): front matter becomes
    metadata, lists in it joined by commas; id is the relative path and url the path without extension and
    without a last ``index``. Headings of Markdown stay as they are."""
    name = pattern.rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    rows = _relative(files.select("content", "_metadata"), root).where(F.col("relative").rlike(glob_regex(pattern))).select("relative", F.col("content").alias("raw"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rel, raw in zip(b.relative, b.raw, strict=True):
                path = PurePosixPath(rel)
                meta, text = html.front_matter(html.decode(bytes(raw)))
                bare = str(path.with_suffix("")).removesuffix("/index")
                kind = "html" if path.suffix == ".html" else "markdown"
                out.append((rel, f"/{bare}", meta.get("title", ""), text, {**meta, "format": kind, "sourcePath": rel}))
            yield pd.DataFrame(out, columns=["id", "url", "title", "content", "metadata"])

    return rows.mapInPandas(read, DOCUMENT)


def generated_html(spark: SparkSession, root: str, bodies: tuple[str, ...] = html.BODIES, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Sections of rendered pages below a folder (see ``SECTION``): body found by selector, navigation and
    other noise removed, metadata and title by precedence, declared encodings honoured."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(root)
    rows = _relative(files.select("content", "_metadata"), root).select("relative", route_of_html(F.col("relative")).alias("route"), F.col("content").alias("raw"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield section_rows(((route, html.decode(bytes(raw)), {"sourcePath": rel}) for rel, route, raw in zip(b.relative, b.route, b.raw, strict=True)), bodies, exclude)

    return rows.mapInPandas(read, SECTION)


def section_rows(pages: Iterable[tuple], bodies: tuple[str, ...], exclude: tuple[str, ...]) -> pd.DataFrame:
    out = []
    for route, text, meta in pages:
        p = html.page(text, route, bodies, exclude)
        out += [(route, route, p["title"], {**p["metadata"], "format": "html", **meta}, k, h, s) for k, (h, s) in enumerate(zip(p["headings"], p["sections"], strict=True))]
    return pd.DataFrame(out, columns=["id", "url", "title", "metadata", "section_ix", "heading", "section"])


def html_sections(pages: DataFrame, bodies: tuple[str, ...] = html.BODIES, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Sections of pages held in a table ``pages(id, html)``; null and empty pages have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield section_rows(((i, t, {}) for i, t in zip(b.id, b.html, strict=True) if isinstance(t, str) and isinstance(i, str)), bodies, exclude)

    return pages.select("id", "html").mapInPandas(read, SECTION)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query, relevant, notes, synthetic) of a JSON-lines file; a line without query or relevant list is an
    error that names it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    got = lines.select("value", F.from_json("value", "query string, relevant array<string>, notes string, synthetic boolean").alias("j"))
    bad = got.where(F.col("j.query").isNull() | F.col("j.relevant").isNull() | (F.trim("j.query") == "")).limit(1).collect()
    if bad:
        raise ValueError(f"not a judgment: {bad[0].value[:200]}")
    return got.select("j.*")


def write_judgments(judgments: DataFrame, path: str) -> None:
    judgments.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def checked(spark: SparkSession, path: str, sha256: str) -> str:
    """The path of a supplied file, once its SHA-256 is the one that was pinned; another one is an error."""
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    if got is None or got[0] != sha256.lower():
        raise ValueError(f"{path} is not the pinned file")
    return path


def read_beir(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus(doc_id, title, text), the judged queries(query_id, text), qrels(query_id, doc_id, rel).

    Ids may be numbers or texts; a document or query given twice, and a judgment of an unknown query, are
    errors; judgments of unknown documents are kept."""
    schema = "_id string, title string, text string"
    corpus = spark.read.schema(schema).json(f"{root}/corpus.jsonl").select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text")
    asked = spark.read.schema(schema).json(f"{root}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    qrels = read_qrels(spark, f"{root}/qrels/{split}.tsv")
    for df, key in ((corpus, ["doc_id"]), (asked, ["query_id"])):
        if df.groupBy(*key).count().where("count > 1").limit(1).collect():
            raise ValueError(f"a {key[0]} occurs twice")
    if qrels.join(asked, "query_id", "left_anti").limit(1).collect():
        raise ValueError("judgments of a query that is not there")
    return corpus, asked.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), qrels


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) of a tab-separated file with or without a header; other rows are errors."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", "\t", -1)
    rows = lines.select("value", parts.alias("p")).where(~F.lower("value").rlike(r"^query[-_]?id\t"))
    bad = rows.where((F.size("p") != 3) | F.expr("try_cast(p[2] AS DOUBLE)").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"not a judgment row: {bad[0].value[:200]}")
    got = rows.select(F.col("p")[0].alias("query_id"), F.col("p")[1].alias("doc_id"), F.col("p")[2].cast("double").alias("rel"))
    if got.groupBy("query_id", "doc_id").count().where("count > 1").limit(1).collect():
        raise ValueError("a document is judged twice for a query")
    return got


RUN = "version int, name string, created_at string, environment map<string,string>, results array<struct<candidate:string,mode:string,ndcg:double,recall:double,rr:double,p50:double,p95:double>>"


def write_run(spark: SparkSession, path: str, run: dict) -> None:
    write_text(spark, path, json.dumps(run, indent=1, sort_keys=True))


REPORT = ("ndcg", "ap", "recall", "precision", "rr")


def ranking_report(results: list[dict], macro: list[dict], checks: list[dict] | None = None, created_at: str = "") -> tuple[str, str]:
    """Results by dataset and engine as JSON and as Markdown: a table a dataset, one of means over the datasets,
    and what the checks found. A latency that is null stands for a run that did not end in its time."""
    body = {"version": 1, "created_at": created_at, "datasets": results, "macro": macro, "checks": checks}
    late = lambda x: "budget exceeded" if x is None else f"{x:.2f}"
    figure = lambda x: "-" if x is None else f"{x:.3f}"
    label = lambda x: str(x).replace("|", "\\|")
    lines = ["# Ranking quality", ""]
    for dataset in dict.fromkeys(r["dataset"] for r in results):
        lines += [f"## {label(dataset)}", "", "| engine | " + " | ".join(REPORT) + " | ms a query |", "|---|" + "---:|" * (len(REPORT) + 1)]
        lines += [f"| {label(r['engine'])} | " + " | ".join(figure(r.get(m)) for m in REPORT) + f" | {late(r.get('query_ms'))} |" for r in results if r["dataset"] == dataset] + [""]
    lines += ["## Means over datasets", "", "| engine | datasets | " + " | ".join(REPORT) + " | ms a query |", "|---|---:|" + "---:|" * (len(REPORT) + 1)]
    lines += [f"| {label(r['engine'])} | {r['datasets']} | " + " | ".join(figure(r.get(m)) for m in REPORT) + f" | {late(r.get('ms_per_query'))} |" for r in macro] + [""]
    if checks is not None:
        lines += ["## Checks", "", "passed" if not checks else "failed", *(f"- {c['kind']}: {c['dataset']}/{c['engine']} (actual {figure(c.get('actual'))}, minimum {figure(c.get('minimum'))})" for c in checks), ""]
    return json.dumps(body, indent=1), "\n".join(lines)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run files, newest first; files that are no run of version 1 are skipped."""
    runs = spark.read.schema(RUN).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return runs.where("version = 1 AND results IS NOT NULL").orderBy(F.desc("created_at"), "name")


def baseline(run: dict) -> dict:
    """A run without what changes from one execution to the next: timings, environment, single queries."""
    still = [{k: 0.0 if k in ("p50", "p95") else v for k, v in r.items() if k != "queries"} for r in run["results"]]
    return {**run, "created_at": "", "environment": {}, "results": still}


def artifact_sizes(spark: SparkSession, path: str, zipped: bool = False) -> DataFrame:
    """(bucket, files, bytes) of an index folder by its tables, and in the row with a null bucket of all; with
    ``zipped`` also ``gzip_bytes``, for which every file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    bucket = F.regexp_extract("path", _quote(path.rstrip("/").split("://", 1)[-1]) + "/+([^/]+)/", 1)

    @F.pandas_udf("long")
    def packed(contents: pd.Series) -> pd.Series:
        return pd.Series([len(gzip.compress(bytes(c))) for c in contents], dtype="int64")

    extra = {"gzip_bytes": packed("content")} if zipped else {}
    sized = files.select("length", bucket.alias("bucket"), *[c.alias(n) for n, c in extra.items()])
    return sized.rollup("bucket").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), *[F.sum(n).alias(n) for n in extra])

