"""The registered queries of the retrieval engine: name -> callable(spark, sf_dir).

The search index is built once per session and input folder, as a service would keep it, and written to
the shared folder; queries read it from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import highlight, scoring, text
from lexloom.operators import chunking, evaluate, runner, search, synthetic, vectors
from lexloom.operators.filters import matches
from lexloom.operators.index import Index, build_index, index_faults, index_of_postings, number_chunks, number_documents, read_index, read_index_v1, unfielded_blocks, unfielded_postings, write_index, write_index_v1
from lexloom.operators.search import Options
from lexloom.plans import config
from lexloom.runtime import delete, materialize, passing, pinned, release, scoped, shared_dir, table
from lexloom.sources import documents as sources
from lexloom.sources import store

_kept: dict[tuple[str, str, str], tuple[tuple, object]] = {}


def _stamp(spark: SparkSession, d: str) -> tuple:
    """Names, sizes and times of the tables of a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(d)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def _once(spark: SparkSession, d: str, name: str, make: Callable[[], object]):
    """What ``make`` gives, kept for the session until the folder's tables change."""
    key, stamp = (spark.sparkContext.applicationId, d, name), _stamp(spark, d)
    if key not in _kept or _kept[key][0] != stamp:
        _kept[key] = stamp, pinned(make)
    return _kept[key][1]


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    """search_chunk as two corpora: pages (absolute url) and repository files, with the metadata of their
    documents. Of repeated rows the last counts."""
    rows = table(spark, d, "search_chunk").where("id IS NOT NULL")
    last = rows.groupBy("id").agg(F.max(F.struct("ingested_at", "content", "document_id", "url", "title", "heading", F.col("metadata")["version"].alias("version"))).alias("r"))
    flat = last.select("id", "r.document_id", "r.url", "r.title", "r.heading", "r.content", "r.version", F.expr("try_cast(r.version AS DOUBLE)").alias("release"))
    docs = table(spark, d, "search_document").where("id IS NOT NULL").groupBy(F.col("id").alias("document_id")).agg(F.max(F.struct("ingested_at", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["tags"].alias("tags"))).alias("m"))
    flat = flat.join(docs.select("document_id", "m.lang", F.split("m.tags", ",").alias("tags")), "document_id", "left")
    corpus = F.when(F.col("url").startswith("http"), "pages").otherwise("repo")
    return number_chunks(flat.withColumn("corpus", corpus), ["id"])


def built(spark: SparkSession, d: str) -> Index:
    return _once(spark, d, "built", lambda: build_index(chunk_table(spark, d), keep=("lang", "version", "tags", "release")))


def stored(spark: SparkSession, d: str) -> Index:
    return _once(spark, d, "stored", lambda: index_of_postings(table(spark, d, "lexical_posting_v2")))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_query").select("query_id", F.col("query_text").alias("text"))


def _num(c: str | Column) -> Column:
    return F.round(c, 6)


def tokenize_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.tokenize(F.col("text"))).alias("n_tokens"))


def fold_terms(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("raw")).distinct()
    return words.select("raw", text.fold(F.col("raw")).alias("folded"))


def stem_terms(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").where("lang = 'en'").select(F.explode(text.tokenize(F.col("text"))).alias("word")).distinct()
    return words.select("word", text.stem_english(F.col("word")).alias("stem"))


def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("title")).alias("title"))


def route_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "search_document").where(text.route_matches(F.col("url"), ["/guides/**", "/howto/*"], ["/guides/how-to-*"]))
    return rows.select("id", "url").distinct()


def _sections(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("url"), "title", F.col("text").alias("content"))
    return chunking.text_sections(docs)


def text_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select("id", "title", "section_ix", "heading", F.sha2("section", 256).alias("section_sha"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("section")).where("section IS NOT NULL")
    return chunking.windows(docs).select("doc_id", "window_ix", "word_offset", F.sha2("content", 256).alias("content_sha"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "search_chunk").select("document_id", "heading").where("document_id IS NOT NULL").distinct()
    return docs.select("document_id", "heading", text.chunk_id(F.col("document_id"), F.col("heading"), F.lit(0)).alias("chunk_id"))


def document_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return number_documents(built(spark, d).chunks)


def postings(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d).postings.select("corpus", "term", "chunk_ix", "tf_title", "tf_heading", "tf_body")


def dictionary_df(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d).dictionary


def field_lengths(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d).lengths


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    s = built(spark, d).stats
    return s.select("corpus", "chunk_count", *[_num(f"avg_{f}").alias(f"avg_{f}") for f in scoring.FIELDS])


def index_checks(spark: SparkSession, d: str) -> DataFrame:
    return index_faults(built(spark, d))


def build_counts(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d).chunks.groupBy("corpus").agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"))


def bm25_v1(spark: SparkSession, d: str) -> DataFrame:
    p, n = _once(spark, d, "unfielded", lambda: tuple(materialize(x, "v1") for x in unfielded_postings(chunk_table(spark, d))))
    return search.unfielded(p, n, asked(spark, d)).select("query_id", "corpus", "chunk_ix", _num("score").alias("score"), F.concat_ws(" ", "terms").alias("terms"))


def expand_terms(spark: SparkSession, d: str) -> DataFrame:
    ix = built(spark, d)
    got = search.expand(search.query_terms(asked(spark, d), ix.analyzer), ix.dictionary, search.corpora_of(asked(spark, d), ix))
    return got.select("query_id", "corpus", "source_ix", "source", "term", "kind", F.coalesce("distance", F.lit(0)).alias("distance"), "boost", "ord")


def expand_typos(spark: SparkSession, d: str) -> DataFrame:
    """Every dictionary word of eight letters or more asked for with two letters swapped, followed by a stop."""
    ix = built(spark, d)
    words = ix.dictionary.select("term").distinct().where("length(term) >= 8")
    swapped = F.concat(F.substring("term", 1, 2), F.substring("term", 4, 1), F.substring("term", 3, 1), F.expr("substring(term, 5)"), F.lit("."))
    q = words.select(F.xxhash64("term").alias("query_id"), "term", swapped.alias("text"))
    got = search.expand(search.query_terms(q, ix.analyzer), ix.dictionary, search.corpora_of(q, ix), 4)
    return got.where("kind = 'fuzzy'").join(q.select("query_id", F.col("term").alias("meant")), "query_id").select("meant", "corpus", "source", "term", "distance", "ord")


def bm25f_exact(spark: SparkSession, d: str) -> DataFrame:
    got = search.lexical_scores(built(spark, d), asked(spark, d), Options(max_expansions=0))
    return got.select("query_id", "corpus", "chunk_ix", _num("lexical_score").alias("score"))


def bm25f_expanded(spark: SparkSession, d: str) -> DataFrame:
    got = search.lexical_scores(built(spark, d), asked(spark, d))
    return got.select("query_id", "corpus", "chunk_ix", _num("lexical_score").alias("score"))


def bm25f_matched_terms(spark: SparkSession, d: str) -> DataFrame:
    got = search.lexical(built(spark, d), asked(spark, d)).select("query_id", "corpus", "chunk_ix", F.explode("terms").alias("t"))
    return got.select("query_id", "corpus", "chunk_ix", "t.source_ix", "t.term", "t.source", "t.kind")


def bm25f_stored(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "search_query").select("query_id", F.col("query_text").alias("text"), "corpus")
    got = search.lexical_scores(stored(spark, d), q, Options(max_expansions=0))
    return got.select("query_id", "corpus", "chunk_ix", _num("lexical_score").alias("score"))


def _page(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "corpus", "chunk_ix", "id", "matches", "total", _num("score").alias("score"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _page(search.search(built(spark, d), asked(spark, d), Options(max_expansions=0), details=False))


def _searched(spark: SparkSession, d: str, **options) -> DataFrame:
    return _page(search.search(built(spark, d), asked(spark, d), Options(max_expansions=0, **options), details=False))


def group_expanded(spark: SparkSession, d: str) -> DataFrame:
    got = search.search(built(spark, d), asked(spark, d), Options(max_expansions=0, group_by="expanded"), details=False)
    return got.select("query_id", "rank", "corpus", "document_id", "matches", F.concat_ws(" ", F.transform("chunks", lambda c: c["id"])).alias("chunk_ids"))


def hydrated(spark: SparkSession, d: str) -> DataFrame:
    got = search.search(built(spark, d), asked(spark, d), Options(max_expansions=0, limit=3), hydrate=True)
    return got.select("query_id", "rank", "id", F.sha2("content", 256).alias("content_sha"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    got = search.search(built(spark, d), asked(spark, d), Options(limit=3), hydrate=True)
    return got.select("query_id", "rank", "id", highlight.snippet(F.col("content"), F.col("terms")).alias("s")).select("query_id", "rank", "id", F.col("s.text").alias("snippet"), F.size("s.ranges").alias("hits"))


def facets_query(spark: SparkSession, d: str) -> DataFrame:
    return search.search_facets(built(spark, d), asked(spark, d), Options(max_expansions=0, facets=("lang", "tags")))


def facets_global(spark: SparkSession, d: str) -> DataFrame:
    return search.global_facets(built(spark, d).chunks, ("lang", "tags"))


def _filtered(spark: SparkSession, d: str, where: dict) -> DataFrame:
    c = built(spark, d).chunks
    return c.where(matches(c, where)).select("corpus", "chunk_ix", "id")


def filter_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where(matches(o, {"o_orderstatus": ["F", "O"], "o_totalprice": {"gte": 1000, "lt": 250000}, "o_orderpriority": {"in": ["1-URGENT", "2-HIGH"], "exists": True}})).select("o_orderkey")


# Vectors ------------------------------------------------------------------------------------------------


def vector_table(spark: SparkSession, d: str) -> DataFrame:
    """Usable vectors as stored: the last of each vec_id, right length, no NaN, null or zero vector."""
    v = F.col("vector_values")
    rows = table(spark, d, "decoded_vector_v2").where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) == F.col("dimensions")))
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0))
    last = rows.groupBy("vec_id").agg(F.max(F.struct("written_at", "corpus", "chunk", v.alias("embedding"))).alias("r"))
    return last.select("vec_id", "r.corpus", F.col("r.chunk").alias("chunk_ix"), "r.embedding")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_query").select("query_id", "corpus", F.col("query_values").alias("query_vector"))


def cosine_all(spark: SparkSession, d: str) -> DataFrame:
    got = vectors.similarities(vector_table(spark, d), _vector_queries(spark, d))
    return got.select("query_id", "corpus", "chunk_ix", _num("cosine").alias("cosine"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    got = vectors.top_similar(vector_table(spark, d), _vector_queries(spark, d), 10)
    return got.select("query_id", "rank", "corpus", "chunk_ix", _num("cosine").alias("cosine"))


def quantize_int8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    scale = scoring.quantize_scale(F.col("embedding"))
    q = F.transform(scoring.quantize(F.col("embedding"), scale), lambda x: x.cast("int"))
    return e.select("vec_id", _num(scale).alias("scale"), F.aggregate(q, F.lit(0), lambda a, x: a + x).alias("total"), F.array_min(q).alias("least"), F.array_max(q).alias("most"))


def cosine_int8(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding against itself after int8 storage: the similarity that the rounding leaves."""
    e = table(spark, d, "embeddings")
    q = vectors.to_int8(e.select("vec_id", "embedding"))
    both = e.select("vec_id", "embedding").join(q, "vec_id")
    return both.select("vec_id", F.round(scoring.cosine(F.col("embedding"), F.col("q")), 4).alias("cosine"))


def hybrid_blend(spark: SparkSession, d: str) -> DataFrame:
    """Stored lexical scores of the default profile, divided by each query's best, blended with the cosine."""
    s = table(spark, d, "lexical_score_v2").where("profile = 'default' AND query_id IS NOT NULL AND corpus IS NOT NULL AND chunk IS NOT NULL")
    s = s.groupBy("query_id", "corpus", F.col("chunk").alias("chunk_ix")).agg(F.max(F.struct("scored_at", "score"))["score"].alias("lex")).where("lex IS NOT NULL")
    top = s.groupBy("query_id", "corpus").agg(F.max("lex").alias("top"))
    cos = vectors.similarities(vector_table(spark, d), _vector_queries(spark, d))
    rows = s.join(top, ["query_id", "corpus"]).join(cos, ["query_id", "corpus", "chunk_ix"], "left")
    score = scoring.blend(F.try_divide("lex", "top"), scoring.semantic(F.col("cosine")), 0.5)
    return rows.where("top > 0").select("query_id", "corpus", "chunk_ix", _num(score).alias("score")).where("score > 0")


def _hashed_index(spark: SparkSession, d: str) -> Index:
    def make() -> Index:
        ix = built(spark, d)
        rows = ix.chunks.join(ix.content, ["corpus", "chunk_ix"])
        key = F.concat_ws("#", "corpus", F.col("chunk_ix").cast("string")).alias("key")
        e = vectors.embed_texts(rows.select(key, text.embedding_text(F.col("title"), F.col("heading"), F.col("content")).alias("text")), vectors.hashing_provider())
        from lexloom.operators.index import with_vectors

        return with_vectors(ix, materialize(e.select(F.substring_index("key", "#", 1).alias("corpus"), F.substring_index("key", "#", -1).cast("int").alias("chunk_ix"), "embedding"), "vectors"))

    return _once(spark, d, "hashed", make)


def hybrid_search(spark: SparkSession, d: str, mode: str = "hybrid") -> DataFrame:
    ix = _hashed_index(spark, d)
    q = asked(spark, d)
    v = vectors.embed_texts(q.select(F.col("query_id").cast("string").alias("key"), "text"), vectors.hashing_provider())
    q = q.join(v.select(F.col("key").cast("long").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")
    return _page(search.search(ix, q, Options(mode=mode, semantic_weight=0.4), details=False))


def embed_hash_provider(spark: SparkSession, d: str) -> DataFrame:
    e = vectors.embed_texts(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text"), vectors.hashing_provider())
    return e.select("key", F.size("embedding").alias("dimensions"), _num(scoring.norm(F.col("embedding"))).alias("norm"))


# Embedding cache ----------------------------------------------------------------------------------------


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache that holds the texts of every even document."""
    own = table(spark, d, "documents").where("doc_id % 2 = 0")
    rows = own.select(F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("provider"), vectors.cache_key("p", F.col("text")).alias("key"), F.array_repeat(F.lit(0.5).cast("float"), 16).alias("embedding"), F.col("ingested_at").alias("accessed_at"))
    return rows


def cache_hits_misses(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.lit("p").alias("provider"), vectors.cache_key("p", F.col("text")).alias("key"))
    return vectors.cache_counts(_texts(spark, d), held, "p")


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    s = vectors.cache_stats(vectors.compact(_cache(spark, d)))
    return s.select(F.coalesce("provider", F.lit("all")).alias("provider"), "entries", "bytes", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


def cache_evict_lru(spark: SparkSession, d: str) -> DataFrame:
    return vectors.evict(_cache(spark, d), 64 * 100).select("provider", "key")


# Evaluation ---------------------------------------------------------------------------------------------


def _scores(spark: SparkSession, d: str, profile: str) -> DataFrame:
    s = table(spark, d, "lexical_score_v2").where((F.col("profile") == profile) & F.col("query_id").isNotNull() & F.col("chunk").isNotNull())
    s = s.groupBy("query_id", "corpus", "chunk").agg(F.max(F.struct("scored_at", "score"))["score"].alias("score")).where("score IS NOT NULL")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus", "chunk")
    return s.select("query_id", F.concat_ws("#", "corpus", F.col("chunk").cast("string")).alias("doc_id"), F.row_number().over(by).alias("rank"))


def run_of(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, "default")


def qrels_of(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, "title_boost").where("rank <= 6").select("query_id", "doc_id", F.greatest(F.lit(0), 4 - F.col("rank")).alias("rel"))


def metric_graded(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.graded_metrics(run_of(spark, d), qrels_of(spark, d), 10)
    return m.select("query_id", *[_num(c).alias(c) for c in ("ndcg", "ap", "recall", "precision", "rr")])


def metric_binary(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.binary_metrics(run_of(spark, d), qrels_of(spark, d).where("rel > 0"), 10)
    return m.select("query_id", *[_num(c).alias(c) for c in ("recall", "rr", "ndcg")])


def metric_means(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.mean_metrics(evaluate.graded_metrics(run_of(spark, d), qrels_of(spark, d), 10))
    return m.select("queries", *[_num(c).alias(c) for c in ("ndcg", "ap", "recall", "precision", "rr")])


def dedup_ranked_ids(spark: SparkSession, d: str) -> DataFrame:
    twice = run_of(spark, d).select("query_id", F.substring_index("doc_id", "#", 1).alias("c"), (F.substring_index("doc_id", "#", -1).cast("long") / 8).cast("long").alias("g"), "rank")
    return evaluate.dedup_ranked(twice.select("query_id", F.concat_ws("#", "c", F.col("g").cast("string")).alias("doc_id"), "rank"), 20)


def _results(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("engine")).agg(F.count(F.lit(1)).alias("queries"), F.sum("o_totalprice").alias("query_ms"), (F.avg("o_totalprice") / 1e6).alias("ndcg"), (F.count(F.lit(1)) % 7 != 0).alias("completed"))


def macro_weighted(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.macro(_results(spark, d), ("ndcg",))
    return m.select("engine", "datasets", _num("ndcg").alias("ndcg"), F.round("ms_per_query", 3).alias("ms_per_query"))


def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d)
    accepted = r.select("dataset", "engine", (F.col("ndcg") + F.when(F.col("engine") == "P", 0.05).otherwise(0.0)).alias("accepted"))
    references = r.groupBy("dataset").agg((F.max("ndcg") + 0.145).alias("reference"))
    g = evaluate.gates(r, accepted, references, "F")
    return g.select("dataset", "engine", "kind", _num("actual").alias("actual"), _num("minimum").alias("minimum"))


def latency_percentile(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency_percentiles(table(spark, d, "events"), ["event_type"], "value")


def run_compare(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d).select(F.col("dataset").alias("candidate"), F.col("engine").alias("mode"), "ndcg", (F.col("ndcg") / 2).alias("recall"), (F.col("ndcg") / 3).alias("rr"))
    after = r.where("mode <> 'O'").withColumn("ndcg", F.col("ndcg") * F.when(F.col("mode") == "P", 0.5).otherwise(1.01))
    c = evaluate.compare_runs(r, after)
    return c.select("candidate", "mode", *[_num(f"{m}_change").alias(f"{m}_change") for m in ("ndcg", "recall", "rr")], "passed")


def salient_terms(spark: SparkSession, d: str) -> DataFrame:
    got = evaluate.salient_terms(built(spark, d).chunks.join(built(spark, d).content, ["corpus", "chunk_ix"]))
    return got.select("corpus", "chunk_ix", "term", _num("salience").alias("salience"))


def synthetic_queries(spark: SparkSession, d: str) -> DataFrame:
    ix = built(spark, d)
    rows = synthetic.synthetic_queries(ix.chunks.join(ix.content, ["corpus", "chunk_ix"]))
    return spark.createDataFrame(rows, "query string, relevant array<string>, synthetic boolean")


# Sources, sinks, streams --------------------------------------------------------------------------------


def html_sections(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "search_document").where(F.col("url").rlike("(?i)^https?://") & F.col("content").rlike(r"(?i)^\s*<(!doctype\s+html|html|head|body)[\s>]"))
    return sources.html_sections(pages.select("id", F.col("content").alias("html")).distinct()).select("id", "title", "section_ix", "heading", "section")


def content_shards(spark: SparkSession, d: str) -> DataFrame:
    c = built(spark, d).content.withColumn("bytes", F.octet_length("content"))
    packed = store.pack_shards(c.select("corpus", "chunk_ix", "bytes"), ["corpus", "chunk_ix"], "bytes")
    return packed.groupBy("corpus", "shard").agg(F.count(F.lit(1)).alias("chunks"), F.sum("bytes").cast("long").alias("bytes"))


def _passing(spark: SparkSession, name: str, use: Callable[[str], DataFrame]) -> DataFrame:
    """What ``use`` makes with a folder of its own, which is deleted once that is a table."""
    root = f"{shared_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex}"
    try:
        return materialize(use(root), name)
    finally:
        delete(spark, root)


def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Writes the index, reads it back and searches it: the same rows as the flagship query."""

    def use(root: str) -> DataFrame:
        write_index(built(spark, d), root)
        return _page(search.search(read_index(spark, root), asked(spark, d), Options(max_expansions=0), details=False))

    return _passing(spark, "index", use)


def index_v1_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Writes the unfielded format, reads it back and ranks over it: the same rows as ``bm25_v1``."""

    root = passing(spark, f"{shared_dir(spark)}/lexloom-v1-{uuid.uuid4().hex}")
    cut = materialize(chunk_table(spark, d), "chunks")
    made = unfielded_blocks(cut)
    write_index_v1(*unfielded_postings(cut, made), cut, root, packed=made)
    release(made, cut)
    p, n, _, _ = read_index_v1(spark, root)
    # The scores, a row for each match, are not copied into a table first: the folder stays until the next call.
    return search.unfielded(p, n, asked(spark, d), spark.read.parquet(f"{root}/blocks")).select("query_id", "corpus", "chunk_ix", _num("score").alias("score"), F.concat_ws(" ", "terms").alias("terms"))


def v1_v2_same_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Where one field holds all words the formats rank alike: for the chunks' contents alone, the score of both."""
    cut = materialize(chunk_table(spark, d).withColumns({"title": F.lit(None).cast("string"), "heading": F.lit(None).cast("string")}), "bare")
    q = asked(spark, d).withColumn("text", F.concat("text", F.lit(" ")))
    q = q.withColumn("text", F.array_join(F.array_distinct(text.tokenize(F.col("text"))), " ")).withColumn("text", F.concat("text", F.lit(" ")))
    got = search.both_scores(cut, text.Analyzer(folding=False), q)
    return got.select("query_id", "corpus", "chunk_ix", _num("score_v1").alias("score_v1"), _num("score_v2").alias("score_v2"))


def _config(spark: SparkSession, d: str) -> dict[str, config.Corpus]:
    """documents as two corpora by language, with a filter field, a facet field and vectors for one of them."""
    docs = table(spark, d, "documents")
    meta = F.map_filter(F.create_map(F.lit("project"), "project", F.lit("source"), "source", F.lit("lang"), "lang"), lambda k, v: v.isNotNull())
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("url"), "title", F.col("text").alias("content"), meta.alias("metadata"), "lang")
    english, rest = rows.where("lang = 'en'").drop("lang"), rows.where("lang <> 'en' OR lang IS NULL").drop("lang")
    return {"english": config.Corpus(english, exclude=("/doc/*7",), filters=("lang",), facets=("project",)), "others": config.Corpus(rest, max_words=60, overlap=10, filters=("lang",), vectors=config.Vectors(vectors.hashing_provider(16)))}


def build_from_config(spark: SparkSession, d: str) -> DataFrame:
    """(corpus, documents, chunks, indexed, projects): counts of the manifest, of the index that a searcher opens, and
    the distinct values of a facet field."""

    def use(root: str) -> DataFrame:
        config.build(spark, _config(spark, d), root, cache=f"{root}/.cache")
        found = config.Searcher(spark, root)
        counts = spark.createDataFrame([(k, v["documents"], v["chunks"]) for k, v in store.read_manifest(spark, root)["corpora"].items()], "corpus string, documents long, chunks long")
        index = found.index()
        chunks = index.chunks.groupBy("corpus").agg(F.count(F.lit(1)).alias("indexed"), F.countDistinct("project").alias("projects"))
        made = index.vectors.groupBy("corpus").agg(F.count(F.lit(1)).alias("vectors"))
        return counts.join(chunks, "corpus", "left").join(made, "corpus", "left").na.fill(0, ["indexed", "projects", "vectors"])

    return _passing(spark, "config", use)


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every title of the chunks as a query, whose documents are relevant."""
    titled = built(spark, d).chunks.where("title IS NOT NULL AND trim(title) <> ''").select("title", "document_id").distinct()
    ids = F.xxhash64("title").alias("query_id")
    return titled.select(ids, F.concat("title", F.lit(" ")).alias("text")).distinct(), titled.select(ids, F.col("document_id").alias("doc_id"))


def run_candidates(spark: SparkSession, d: str) -> DataFrame:
    """(candidate, mode, recall, rr, ndcg) of title queries under three candidates."""
    q, j = _judged(spark, d)
    plain = {"max_expansions": 0}
    candidates = {"default": runner.Candidate(query=plain), "titles": runner.Candidate(query={**plain, "weights": {"title": 5.0, "heading": 1.0, "body": 0.5}}), "chunks": runner.Candidate(query={**plain, "group_by": "none"})}
    run, _ = runner.run_candidates(spark, candidates, lambda c: (built(spark, d), ("lexical",)), materialize(q, "asked"), materialize(j, "judged"))
    return spark.createDataFrame([(r["candidate"], r["mode"], *(round(r[m], 6) for m in ("recall", "rr", "ndcg"))) for r in run["results"]], "candidate string, mode string, recall double, rr double, ndcg double")


def incremental_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """documents as three waves of files that a stream follows; (document_id, term, tf_*) of the index in the end."""
    from lexloom.streaming import incremental

    def use(root: str) -> DataFrame:
        docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("url"), "title", F.col("text").alias("content"), F.lit("docs").alias("corpus"), F.col("ingested_at").alias("updated_at"))
        for wave in range(3):
            # Every wave brings new documents and, as changes, those of the wave before with another title.
            now, before = docs.where(F.pmod(F.col("id").cast("long"), F.lit(3)) == wave), docs.where(F.pmod(F.col("id").cast("long"), F.lit(3)) == wave - 1)
            now.unionByName(before.withColumn("title", F.concat(F.lit("Again "), F.coalesce("title", F.lit("untitled"))))).write.mode("append").parquet(f"{root}/in")
            incremental.watch(spark, f"{root}/in", f"{root}/out", vectors.hashing_provider(16)).awaitTermination()
        index = incremental.current_index(spark, f"{root}/out")
        tf = ["tf_title", "tf_heading", "tf_body"]
        return index.postings.join(index.chunks.select("corpus", "chunk_ix", "document_id"), ["corpus", "chunk_ix"]).groupBy("document_id", "term").agg(*[F.sum(c).cast("int").alias(c) for c in tf])

    return _passing(spark, "stream", use)


_MADE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship,
    "tokenize_count": tokenize_count,
    "fold_terms": fold_terms,
    "stem_terms": stem_terms,
    "clean_titles": clean_titles,
    "route_filter": route_filter,
    "text_sections": text_sections,
    "chunk_windows": chunk_windows,
    "chunk_ids": chunk_ids,
    "document_ordinals": document_ordinals,
    "postings": postings,
    "dictionary_df": dictionary_df,
    "field_lengths": field_lengths,
    "corpus_stats": corpus_stats,
    "index_checks": index_checks,
    "build_counts": build_counts,
    "bm25_v1": bm25_v1,
    "expand_terms": expand_terms,
    "expand_typos": expand_typos,
    "bm25f_exact": bm25f_exact,
    "bm25f_expanded": bm25f_expanded,
    "bm25f_matched_terms": bm25f_matched_terms,
    "bm25f_stored": bm25f_stored,
    "group_none": partial(_searched, group_by="none"),
    "group_expanded": group_expanded,
    "page_offset_limit": partial(_searched, group_by="none", offset=3, limit=4),
    "corpus_subset": partial(_searched, corpora=("repo",)),
    "search_where": partial(_searched, where={"lang": "en", "release": {"gte": 2, "lt": 4}, "tags": ["cache", "query", "index"]}),
    "hydrated": hydrated,
    "snippets": snippets,
    "facets_query": facets_query,
    "facets_global": facets_global,
    "filter_eq": partial(_filtered, where={"lang": "en"}),
    "filter_in_array": partial(_filtered, where={"tags": {"in": ["cache", "query"]}}),
    "filter_range": partial(_filtered, where={"release": {"gte": 1.5, "lte": 3}}),
    "filter_exists": partial(_filtered, where={"tags": {"exists": False}}),
    "filter_null": partial(_filtered, where={"lang": None}),
    "filter_orders": filter_orders,
    "cosine_all": cosine_all,
    "cosine_topk": cosine_topk,
    "quantize_int8": quantize_int8,
    "cosine_int8": cosine_int8,
    "hybrid_blend": hybrid_blend,
    "hybrid_search": hybrid_search,
    "semantic_search": partial(hybrid_search, mode="semantic"),
    "embed_hash_provider": embed_hash_provider,
    "cache_hits_misses": cache_hits_misses,
    "cache_stats": cache_stats,
    "cache_evict_lru": cache_evict_lru,
    "metric_graded": metric_graded,
    "metric_binary": metric_binary,
    "metric_means": metric_means,
    "dedup_ranked_ids": dedup_ranked_ids,
    "macro_weighted": macro_weighted,
    "quality_gates": quality_gates,
    "latency_percentile": latency_percentile,
    "run_compare": run_compare,
    "salient_terms": salient_terms,
    "synthetic_queries": synthetic_queries,
    "html_sections": html_sections,
    "content_shards": content_shards,
    "index_round_trip": index_round_trip,
    "index_v1_round_trip": index_v1_round_trip,
    "v1_v2_same_ranking": v1_v2_same_ranking,
    "build_from_config": build_from_config,
    "run_candidates": run_candidates,
    "incremental_rebuild": incremental_rebuild,
}

QUERIES = {name: scoped(make) for name, make in _MADE.items()}
