"""Batches of ranked queries over an index: lexical, semantic, hybrid; filters, facets, groups, pages."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.functions.scoring import WEIGHTS, bm25f
from lexloom.functions.text import Analyzer, tokenize
from lexloom.operators import blocks
from lexloom.operators.expand import BUDGET, expand, query_terms
from lexloom.operators.filters import matches
from lexloom.operators.index import Index, blocks_of, first_list, indexed_blocks, twice_counted, unfielded_postings
from lexloom.runtime import materialize

KEYS = ["query_id", "corpus", "chunk_ix"]
MODES = ("lexical", "semantic", "hybrid")
TERMS = "array<struct<source_ix:int,term:string,source:string,kind:string,distance:int>>"
RESULT = ["query_id", "rank", "corpus", "document_id", "chunk_ix", "id", "score", "lexical_score", "semantic_score", "matches"]


@dataclass(frozen=True)
class Options:
    """Options of a batch of queries; ``corpora`` none or empty means all."""

    mode: str = "lexical"
    corpora: tuple[str, ...] = ()
    where: Mapping[str, Any] | None = None
    facets: tuple[str, ...] = ()
    group_by: str = "document"
    limit: int = 10
    offset: int = 0
    semantic_weight: float = 0.5
    max_expansions: int = BUDGET
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))


def corpora_of(queries: DataFrame, index: Index, names: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, corpus): where each query looks. A ``corpus`` column of the queries names one corpus;
    a null there, as an empty selection, means all of them."""
    # One row a corpus: the statistics table, not data that grows with the chunks.
    known = index.stats.select("corpus").where(F.col("corpus").isin(*names) if names else F.lit(True))
    every = F.array(*[F.lit(r.corpus) for r in known.orderBy("corpus").collect()]).cast("array<string>")
    look = every
    if "corpus" in queries.columns:
        look = F.when(F.col("corpus").isNull(), every).otherwise(F.filter(every, lambda c: c == F.col("corpus")))
    return queries.select("query_id", F.explode(look).alias("corpus"))


def expansions(index: Index, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """The words of the queries with the terms they look for (see ``expand``), as a table: a few rows a word."""
    terms = expand(query_terms(queries, index.analyzer), index.dictionary, corpora_of(queries, index, options.corpora), options.max_expansions)
    return materialize(terms, "terms")


def _hits(index: Index, terms: DataFrame, options: Options) -> DataFrame:
    """Every posting of a term that a query looks for, with its score. Postings hold the lengths of their chunk and
    meet the terms by term; few terms are broadcast, so that postings stay where they are."""
    postings = index.postings
    if "len_body" not in postings.columns:
        postings = postings.join(index.lengths, KEYS[1:])
    hits = postings.join(terms, [c for c in ("corpus", "term", "chunk_ix") if c in terms.columns]).join(index.stats, "corpus")
    return hits.select(*KEYS, "source_ix", bm25f(F.col("df"), F.col("chunk_count"), dict(options.weights), F.col("boost")).alias("s"), (-F.col("ord")).alias("o"), "term", "source", "kind", "distance")


def _found(hits: DataFrame) -> DataFrame:
    """(query_id, corpus, chunk_ix, lexical_score, terms): by word the best expansion, of equal ones the first."""
    best = hits.repartition(*KEYS).groupBy(*KEYS, "source_ix").agg(F.max(F.struct("s", "o", "term", "source", "kind", "distance")).alias("b")).select(*KEYS, "source_ix", "b.*")
    found = F.struct("source_ix", "term", "source", "kind", "distance")
    return best.groupBy(*KEYS).agg(F.sum("s").alias("lexical_score"), F.sort_array(F.collect_list(found)).alias("terms"))


def lexical(index: Index, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """(query_id, corpus, chunk_ix, lexical_score, terms): fielded BM25 of every chunk with a matched term.

    A chunk takes the best expansion of each query word (of equal ones the first) and adds the words up;
    a repeated word counts again. The hits are shuffled once, by query and chunk, for both.
    """
    return _found(_hits(index, expansions(index, queries, options), options))


def lexical_scores(index: Index, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """``lexical`` without the terms. Scores are made block by block, so no hit is shuffled."""
    return _every(blocks_of(index), expansions(index, queries, options), index.stats, dict(options.weights), blocks.scores, "lexical_score double")


def _every(packed: DataFrame, terms: DataFrame, stats: DataFrame, weights: dict, make, last: str) -> DataFrame:
    field = terms.schema["query_id"].dataType
    schema = f"query_id {field.simpleString()}, corpus string, chunk_ix int, {last}"
    out = [blocks.over(packed, blocks.shared(packed.sparkSession, a, partial(make, kind=to_arrow_type(field))), schema) for a in blocks.passes(terms, None, stats, weights) if a.corpora]
    return reduce(DataFrame.unionByName, out) if out else packed.sparkSession.createDataFrame([], schema)


UNFIELDED = {"title": 0.0, "heading": 0.0, "body": 1.0}


def _unfielded_terms(postings: DataFrame, lengths: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the words of the queries as ``expansions`` has them, statistics) for unfielded BM25, which is the fielded one of
    a single field; a repeated query word counts once."""
    stats = lengths.groupBy("corpus").agg(F.count(F.lit(1)).alias("chunk_count"), F.avg("length").alias("avg_body")).withColumns({"avg_title": F.lit(0.0), "avg_heading": F.lit(0.0)})
    words = queries.select("query_id", F.posexplode(F.array_distinct(tokenize(F.col("text")))).alias("source_ix", "term"))
    df = postings.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))
    return materialize(words.join(df, "term").select("query_id", "corpus", "source_ix", F.col("term").alias("source"), F.lit(False).alias("prefix"), "term", "df", F.lit(1.0).alias("boost")), "terms"), stats


def unfielded(postings: DataFrame, lengths: DataFrame, queries: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """(query_id, corpus, chunk_ix, score, terms) by unfielded BM25; a repeated query word counts once. Without
    ``packed``, the blocks, these are made of the postings."""
    asked, stats = _unfielded_terms(postings, lengths, queries)
    if packed is None:
        # Only postings that are asked for are listed by chunk.
        zero = {f: F.lit(0).alias(f) for f in ("tf_title", "tf_heading", "len_title", "len_heading")}
        some = postings.join(asked.select("corpus", "term").distinct(), ["corpus", "term"], "left_semi").select("corpus", "term", "chunk_ix", zero["tf_title"], zero["tf_heading"], F.col("tf").alias("tf_body"))
        words_of = some.groupBy("corpus", "chunk_ix").agg(F.collect_list(F.struct("term", "tf_title", "tf_heading", "tf_body")).alias("words"))
        own = F.col("chunk_ix").cast("string")
        rows = words_of.join(lengths, ["corpus", "chunk_ix"]).select("corpus", "chunk_ix", own.alias("id"), own.alias("document_id"), zero["len_title"], zero["len_heading"], F.col("length").alias("len_body"), "words")
        packed = materialize(blocks.pack(rows, lengths.count()), "listed")
    return _every(packed, asked, stats, UNFIELDED, blocks.named_scores, "score double, terms array<string>")


def both_scores(chunks: DataFrame, analyzer: Analyzer, queries: DataFrame) -> DataFrame:
    """(query_id, corpus, chunk_ix, score_v2, score_v1): scores of the fielded index without expansions and of the
    unfielded format, of every chunk that either finds. A block holds both, so no score is shuffled to meet the other."""
    packed = twice_counted(chunks, analyzer)
    two, one = first_list(packed), first_list(packed, "_1")
    index = indexed_blocks(chunks, two, analyzer)
    terms = expansions(index, queries, Options(max_expansions=0))
    asked, stats = _unfielded_terms(*unfielded_postings(chunks, one), queries)
    field = queries.schema["query_id"].dataType
    schema = f"query_id {field.simpleString()}, corpus string, chunk_ix int, score_v2 double, score_v1 double"
    part = F.pmod(F.xxhash64("query_id"), F.lit(n := 1 + (terms.count() + asked.count()) // blocks.PASS_TERMS))
    out = []
    for k in range(n):
        sides = [next(iter(blocks.passes(t.where(part == k), None, s, w, whole=True)), None) for t, s, w in ((terms, index.stats, dict(WEIGHTS)), (asked, stats, UNFIELDED))]
        if any(s.corpora for s in sides):
            out.append(blocks.over(packed, blocks.shared(packed.sparkSession, tuple(sides), partial(blocks.both, kind=to_arrow_type(field))), schema))
    return reduce(DataFrame.unionByName, out) if out else packed.sparkSession.createDataFrame([], schema)


def _passes(index: Index, queries: DataFrame, options: Options, columns: tuple[str, ...] = ()) -> tuple[DataFrame | None, list, DataFrame | None]:
    """(blocks with the filter of every chunk, the queries in passes with each query's best lexical score, their terms).

    The lexical score is divided by the best of its query and corpus *before* the filter. Semantic and
    hybrid queries take the vectors of the index and ``queries.query_vector``; a hybrid query without
    vectors is lexical, a semantic one finds nothing.
    """
    if options.mode not in MODES:
        raise ValueError(f"unknown mode {options.mode!r}")
    if options.group_by not in ("document", "none", "expanded"):
        raise ValueError(f"unknown grouping {options.group_by!r}")
    terms = expansions(index, queries, options) if options.mode != "semantic" else None
    pairs = None
    if options.mode != "lexical" and index.vectors is not None:
        pairs = corpora_of(queries, index, options.corpora).join(queries.select("query_id", "query_vector").where("query_vector IS NOT NULL"), "query_id")
    packed = blocks_of(index, (*columns, *(options.where or {})), pairs is not None)
    asked = [a for a in blocks.passes(terms, pairs, index.stats, dict(options.weights)) if a.corpora]
    for a in asked:
        blocks.find_tops(packed, a)
    if options.where:
        packed = packed.withColumn("_mask", F.transform("rows", lambda x: F.coalesce(matches(index.chunks, options.where, lambda f: F.col("corpus") if f == "corpus" else x[f]), F.lit(False))))
    return packed, asked, terms


def _tie(score: str) -> Column:
    """Scores as they are ordered: sums that differ by the order of adding only are equal."""
    return F.round(score, 9)


def _each_pass(packed: DataFrame, asked: list, queries: DataFrame, make, rest: str) -> DataFrame:
    field = queries.schema["query_id"].dataType
    schema, kind = rest.format(id=field.simpleString()), to_arrow_type(field)
    out = [blocks.over(packed, blocks.shared(packed.sparkSession, a, partial(make, kind=kind)), schema) for a in asked]
    return reduce(DataFrame.unionByName, out) if out else packed.sparkSession.createDataFrame([], schema)


def paged(rows: DataFrame, offset: int = 0, limit: int = 10) -> DataFrame:
    """Adds ``rank`` and ``total`` to the first results that each task has kept and keeps the page. Results stand in order
    of score, corpus and id; ``rank`` counts from 1 within a query."""
    one = Window.partitionBy("query_id")
    # Rows that bring a count only come last.
    order = [F.col("id").isNull(), _tie("score").desc(), F.col("corpus"), F.col("id"), F.col("chunk_ix")]
    page = rows.withColumn("total", F.sum("total").over(one)).withColumn("rank", F.row_number().over(one.orderBy(*order)))
    return page.where(F.col("chunk_ix").isNotNull() & (F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def global_facets(chunks: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(corpus, field, value, number) over all chunks; missing values are not counted."""
    kinds = {f.name: f.dataType.typeName() for f in chunks.schema.fields}
    texts = lambda f: F.array_distinct(F.col(f).cast("array<string>")) if kinds[f] == "array" else F.array(F.col(f).cast("string"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), texts(f).alias("values")) for f in fields])
    each = chunks.select("corpus", F.explode(pairs).alias("p")).select("corpus", "p.field", F.explode("p.values").alias("value")).where("value IS NOT NULL")
    return each.groupBy("corpus", "field", "value").agg(F.count(F.lit(1)).alias("number"))


def search(index: Index, queries: DataFrame, options: Options = Options(), hydrate: bool = False, details: bool = True) -> DataFrame:
    """The result page of every query of ``queries(query_id, text[, corpus][, query_vector])``.

    Columns: those of ``RESULT``, ``total``, ``terms``, the metadata columns, ``chunks`` where expanded,
    and with ``hydrate`` the content. All that neither orders nor filters is joined after the page is cut; without
    ``details`` it is left out: terms, metadata and content.
    """
    packed, asked, terms = _passes(index, queries, options)
    offset, limit = max(0, int(options.offset)), max(0, int(options.limit))
    make = partial(blocks.pages, mode=options.mode, weight=options.semantic_weight, group=options.group_by, keep=offset + limit)
    listed = "query_id {id}, corpus string, chunk_ix int, id string, document_id string, score double, lexical_score double, semantic_score double, matches long, chunks array<struct<id:string,score:double>>, total long"
    page = paged(_each_pass(packed, asked, queries, make, listed), offset, limit)
    page = materialize(page if options.group_by == "expanded" else page.drop("chunks"), "page")
    if not details:
        return page
    late = [c for c in index.chunks.columns if c not in page.columns]
    page = page.join(_of_page(index.chunks.select("corpus", "chunk_ix", *late), page), KEYS[1:], "left")
    if terms is None:
        page = page.withColumn("terms", F.array().cast(TERMS))
    else:
        # Only postings of the page's chunks meet the terms, for what matched.
        wanted = page.select(*KEYS).join(terms, ["query_id", "corpus"])
        own = _of_page(index.postings.select("corpus", "term", "chunk_ix", *[c for c in index.postings.columns if c.startswith(("tf_", "len_"))]), page)
        named = _found(_hits(replace(index, postings=own), wanted, options)).select(*KEYS, "terms")
        page = page.join(named, KEYS, "left").withColumn("terms", F.coalesce("terms", F.array().cast(TERMS)))
    if hydrate and index.content is not None:
        page = page.join(_of_page(index.content, page), ["corpus", "chunk_ix"], "left")
    return page


# Chunks of a page that are looked up by broadcast.
PAGE_KEYS = 500_000


def _of_page(rows: DataFrame, page: DataFrame) -> DataFrame:
    """The rows of the page's chunks; unless the page is very large, the rest of the table stays where it is."""
    keys = page.select("corpus", "chunk_ix").distinct()
    return rows.join(F.broadcast(keys) if page.count() <= PAGE_KEYS else keys, ["corpus", "chunk_ix"], "left_semi")


def search_facets(index: Index, queries: DataFrame, options: Options) -> DataFrame:
    """Facet counts over all grouped results, before the page is cut: (query_id, field, value, number). A list counts
    once for each distinct value, a missing value as ``null``."""
    kinds = {f.name: f.dataType.typeName() for f in index.chunks.schema.fields}

    def texts(f: str, c: Column) -> Column:
        one = F.coalesce(c.cast("string"), F.lit("null"))
        if kinds[f] != "array":
            return F.array(one)
        return F.when(c.isNull(), F.array(F.lit("null"))).otherwise(F.array_distinct(F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("null")))))

    packed, asked, _ = _passes(index, queries, options, options.facets)
    packed = packed.withColumn("_values", F.transform("rows", lambda x: F.array(*[texts(f, F.col("corpus") if f == "corpus" else x[f]) for f in options.facets])))
    make = partial(blocks.facets, mode=options.mode, weight=options.semantic_weight, group=options.group_by, fields=options.facets)
    each = _each_pass(packed, asked, queries, make, "query_id {id}, field string, value string, number long")
    return each.groupBy("query_id", "field", "value").agg(F.sum("number").alias("number"))


def query(index: Index, text: str, options: Options = Options(), vector: list[float] | None = None, hydrate: bool = True) -> DataFrame:
    """One query; a wrapper of ``search``."""
    asked = index.stats.sparkSession.createDataFrame([(0, text, vector)], "query_id long, text string, query_vector array<float>")
    return search(index, asked, options, hydrate).drop("query_id").orderBy("rank")
