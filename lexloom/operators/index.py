"""The fielded inverted index as DataFrames: postings, dictionary, lengths, statistics."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.scoring import FIELDS
from lexloom.functions.text import Analyzer, analyze_token, index_text, tokenize, tokens
from lexloom.operators import blocks
from lexloom.operators.scan import range_layout, running_sum
from lexloom.runtime import materialize, pinned, release


POSTING = ["corpus", "term", "chunk_ix", *[f"tf_{f}" for f in FIELDS], *[f"len_{f}" for f in FIELDS]]


@dataclass
class Index:
    """One table each for all corpora.

    chunks(corpus, chunk_ix, id, document_id, ...), postings(corpus, term, chunk_ix, tf_title, tf_heading,
    tf_body, len_title, len_heading, len_body), each with the lengths of its chunk, dictionary(corpus, term, df), lengths(corpus, chunk_ix, len_*), stats(corpus, chunk_count,
    avg_*). ``content`` holds what is only read for a result page; ``vectors(corpus, chunk_ix, embedding)``.
    ``blocks(corpus, rows)`` has whole documents with the words of their chunks, see ``operators/blocks.py``.
    """

    chunks: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    lengths: DataFrame
    stats: DataFrame
    content: DataFrame | None = None
    vectors: DataFrame | None = None
    analyzer: Analyzer = Analyzer()
    blocks: DataFrame | None = None
    _with_vectors: tuple[DataFrame, DataFrame] | None = field(default=None, repr=False, compare=False)


def number_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``chunk_ix``, from 0 without gaps within a corpus, in the order of ``order`` (a total order)."""
    laid = range_layout(chunks, ["corpus"], order)
    got = running_sum(laid, ["corpus"], order, F.lit(1), "_n")
    return got.withColumn("chunk_ix", (F.col("_n") - 1).cast("int")).drop("_n", "_range")


def number_documents(chunks: DataFrame) -> DataFrame:
    """(corpus, document_id, document_ix): documents by first appearance among the chunks."""
    first = chunks.groupBy("corpus", "document_id").agg(F.min("chunk_ix").alias("first_chunk"))
    order = ["first_chunk", "document_id"]
    got = running_sum(range_layout(first, ["corpus"], order), ["corpus"], order, F.lit(1), "_n")
    return got.select("corpus", "document_id", (F.col("_n") - 1).cast("int").alias("document_ix"))


def field_terms(chunks: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(corpus, chunk_ix, field, term, tf) of the words longer than one character after analysis; words that
    become one term have a row each, for ``postings_of`` to add up."""
    text = {"title": "title", "heading": "heading", "body": "content"}
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(text[f])).alias("words")) for f in FIELDS])
    words = chunks.select("corpus", "chunk_ix", F.explode(fields).alias("f")).select("corpus", "chunk_ix", "f.field", F.explode("f.words").alias("raw"))
    # Equal words of a field are counted before they are analysed.
    raw = words.groupBy("corpus", "chunk_ix", "field", "raw").agg(F.count(F.lit(1)).alias("n"))
    return raw.select("corpus", "chunk_ix", "field", analyze_token(F.col("raw"), analyzer).alias("term"), F.col("n").alias("tf")).where(F.length("term") > 1)


def postings_of(terms: DataFrame) -> DataFrame:
    tf = [F.sum(F.when(F.col("field") == f, F.col("tf")).otherwise(0)).cast("int").alias(f"tf_{f}") for f in FIELDS]
    return terms.groupBy("corpus", "term", "chunk_ix").agg(*tf)


def lengths_of(postings: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Terms a field by chunk; chunks without terms have zeros where the chunks are given."""
    got = postings.groupBy("corpus", "chunk_ix").agg(*[F.sum(f"tf_{f}").cast("int").alias(f"len_{f}") for f in FIELDS])
    if chunks is None:
        return got
    return chunks.select("corpus", "chunk_ix").join(got, ["corpus", "chunk_ix"], "left").na.fill(0, [f"len_{f}" for f in FIELDS])


def stats_of(lengths: DataFrame) -> DataFrame:
    """Chunk count and mean field lengths by corpus; the means go through single precision, as stored."""
    return lengths.groupBy("corpus").agg(F.count(F.lit(1)).alias("chunk_count"), *[F.avg(f"len_{f}").cast("float").cast("double").alias(f"avg_{f}") for f in FIELDS])


def dictionary_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))


def build_index(chunks: DataFrame, analyzer: Analyzer = Analyzer(), keep: tuple[str, ...] = ()) -> Index:
    """An index of ``chunks(corpus, chunk_ix, id, document_id, url, title, heading, content, ...)``.

    ``keep`` names the metadata columns that filters and facets may use; the content stays in its own
    table. Null fields count as empty. An empty table gives an empty index.
    """
    chunks = materialize(chunks, "chunks")
    if analyzer.stemmer is not None:
        return assemble(chunks, materialize(postings_of(field_terms(chunks, analyzer)), "counted"), analyzer, keep)
    text = {"title": "title", "heading": "heading", "body": "content"}
    words = {f: tokens(F.col(c)) for f, c in text.items()}
    split = chunks.select("corpus", "chunk_ix", "id", "document_id", *keep, *[(w if analyzer.folding else F.transform(w, F.lower)).alias(f"_{f}") for f, w in words.items()])
    return _indexed(chunks, blocks.count_words(split, tuple(f"_{f}" for f in FIELDS), analyzer.folding), analyzer, keep)


def assemble(chunks: DataFrame, counted: DataFrame, analyzer: Analyzer = Analyzer(), keep: tuple[str, ...] = ()) -> Index:
    """The index of chunks whose words are counted: ``counted(corpus, term, chunk_ix, tf_*)``. Both are tables
    of ``materialize``; that of the counts is given up."""
    got = _indexed(chunks, _forward(chunks.select("corpus", "chunk_ix", "id", "document_id", *keep), counted), analyzer, keep)
    release(counted)
    return got


def _forward(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """``chunks`` with ``words``, the postings of each as a list."""
    words = postings.groupBy("corpus", "chunk_ix").agg(F.collect_list(F.struct("term", *[f"tf_{f}" for f in FIELDS])).alias("words"))
    return chunks.join(words, ["corpus", "chunk_ix"], "left").withColumn("words", F.coalesce("words", F.array().cast(blocks.WORDS)))


def _indexed(chunks: DataFrame, forward: DataFrame, analyzer: Analyzer, keep: tuple[str, ...]) -> Index:
    """The index whose words ``forward`` lists by chunk. Its blocks are a table; postings are read from it."""
    return indexed_blocks(chunks, materialize(blocks.pack(forward, chunks.count()), "blocks"), analyzer, keep)


def indexed_blocks(chunks: DataFrame, packed: DataFrame, analyzer: Analyzer, keep: tuple[str, ...] = ()) -> Index:
    lengths = materialize(blocks.flat(packed, "chunk_ix", *[f"len_{f}" for f in FIELDS]), "lengths")
    postings = postings_in(packed)
    scored = chunks.select("corpus", "chunk_ix", "id", "document_id", "url", "title", "heading", *keep)
    return Index(scored, postings, materialize(dictionary_of(postings), "dictionary"), lengths, stats_of(lengths), chunks.select("corpus", "chunk_ix", "content"), None, analyzer, packed)


def postings_in(packed: DataFrame) -> DataFrame:
    each = blocks.flat(packed, "chunk_ix", *[f"len_{f}" for f in FIELDS], "words").select("*", F.explode("words").alias("w"))
    return each.select("corpus", "w.term", "chunk_ix", *[f"w.tf_{f}" for f in FIELDS], *[f"len_{f}" for f in FIELDS])


def blocks_of(index: Index, columns: tuple[str, ...] = (), vectors: bool = False) -> DataFrame:
    """The blocks of an index with the given columns of its chunks, and ``embedding`` where vectors are asked for; what
    the index lacks is made once from its other tables."""
    count = index.stats.agg(F.sum("chunk_count")).first()[0] or 0
    late = ("url", "title", "heading", "content", "metadata")
    if index.blocks is None:
        plain = index.chunks.select(*[c for c in index.chunks.columns if c not in late])
        index.blocks = pinned(lambda: materialize(blocks.pack(_forward(plain, index.postings), count), "blocks"))
    got = index.blocks
    if vectors and index.vectors is not None:
        if index._with_vectors is None or index._with_vectors[0] is not index.vectors:
            rows = blocks.flat(got, *got.schema["rows"].dataType.elementType.names)
            joined = rows.join(index.vectors.select("corpus", "chunk_ix", "embedding"), ["corpus", "chunk_ix"], "left")
            index._with_vectors = index.vectors, pinned(lambda: materialize(blocks.pack(joined, count), "vectorblocks"))
        got = index._with_vectors[1]
    names = got.schema["rows"].dataType.elementType.names
    if more := [c for c in columns if c in index.chunks.columns and c not in names and c != "corpus"]:
        rows = blocks.flat(got, *names).join(index.chunks.select("corpus", "chunk_ix", *more), ["corpus", "chunk_ix"])
        got = materialize(blocks.pack(rows, count), "blocks")
    return got


def index_of_postings(v2: DataFrame) -> Index:
    """An index of stored postings (corpus, term, chunk, frequencies [title, heading, body], ingested_at).

    Of rows of one posting the last to arrive counts (at equal arrival the larger list); missing lists
    and elements are 0 and postings without an occurrence do not exist. Terms are taken as stored.
    """
    rows = v2.where("corpus IS NOT NULL AND term IS NOT NULL AND chunk IS NOT NULL")
    tf = [F.greatest(F.lit(0), F.coalesce(F.get("frequencies", F.lit(k)), F.lit(0))).alias(f"tf_{f}") for k, f in enumerate(FIELDS)]
    last = rows.groupBy("corpus", "term", F.col("chunk").alias("chunk_ix")).agg(F.max(F.struct("ingested_at", F.struct(*tf).alias("f")))["f"].alias("f"))
    counted = materialize(last.select("corpus", "term", "chunk_ix", "f.*").where("tf_title + tf_heading + tf_body > 0"), "counted")
    lengths = materialize(lengths_of(counted), "lengths")
    postings = materialize(counted.join(lengths, ["corpus", "chunk_ix"]).select(*POSTING), "postings")
    release(counted)
    chunks = lengths.select("corpus", "chunk_ix", F.concat_ws("#", "corpus", F.col("chunk_ix").cast("string")).alias("id"), F.concat_ws("#", "corpus", F.floor(F.col("chunk_ix") / 4).cast("string")).alias("document_id"))
    return Index(chunks, postings, materialize(dictionary_of(postings), "dictionary"), lengths, stats_of(lengths))


def unfielded_blocks(chunks: DataFrame) -> DataFrame:
    """The blocks of the older format: title, heading and content as one lower-cased text, counted as the body."""
    split = chunks.select("corpus", "chunk_ix", "id", "document_id", tokenize(index_text(F.col("title"), F.col("heading"), F.col("content"))).alias("_body")).withColumns({f"_{f}": F.array().cast("array<string>") for f in ("title", "heading")})
    return materialize(blocks.pack(blocks.count_words(split, tuple(f"_{f}" for f in FIELDS), False), chunks.count()), "blocks")


def unfielded_postings(chunks: DataFrame, packed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The older format: postings(corpus, term, chunk_ix, tf) and lengths(corpus, chunk_ix, length) of title,
    heading and content as one lower-cased text; read from ``unfielded_blocks``."""
    packed = unfielded_blocks(chunks) if packed is None else packed
    return postings_in(packed).select("corpus", "term", "chunk_ix", F.col("tf_body").alias("tf")), blocks.flat(packed, "chunk_ix", "len_body").withColumnRenamed("len_body", "length")


def twice_counted(chunks: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Blocks that hold the words of a fielded index without stemmer (``words``, ``len_*``) and those of the unfielded
    format (``words_1``, ``len_1_*``)."""
    fields = tuple(f"_{f}" for f in FIELDS)
    lower = lambda c: tokens(F.col(c)) if analyzer.folding else F.transform(tokens(F.col(c)), F.lower)
    none = F.array().cast("array<string>")
    split = chunks.select("corpus", "chunk_ix", "id", "document_id", tokenize(index_text(F.col("title"), F.col("heading"), F.col("content"))).alias("_one"), lower("title").alias("_title"), lower("heading").alias("_heading"), lower("content").alias("_body"))
    first = blocks.with_lengths(blocks.count_words(split, fields, analyzer.folding))
    first = first.withColumnsRenamed({"words": "words_2", **{f"len_{f}": f"len_2_{f}" for f in FIELDS}}).withColumns({"_title": none, "_heading": none}).withColumnRenamed("_one", "_body")
    second = blocks.with_lengths(blocks.count_words(first, fields, False))
    second = second.withColumnsRenamed({"words": "words_1", **{f"len_{f}": f"len_1_{f}" for f in FIELDS}}).withColumnsRenamed({"words_2": "words", **{f"len_2_{f}": f"len_{f}" for f in FIELDS}})
    return materialize(blocks.pack(second, chunks.count()), "blocks")


def first_list(packed: DataFrame, mark: str = "") -> DataFrame:
    """One list of words of ``twice_counted``, as blocks of its own: the fielded one, or with ``mark`` "_1" the other."""
    pick = lambda x: F.struct(x["chunk_ix"].alias("chunk_ix"), x["id"].alias("id"), x["document_id"].alias("document_id"), x[f"words{mark}"].alias("words"), *[x[f"len{mark}_{f}"].alias(f"len_{f}") for f in FIELDS])
    return packed.select("corpus", F.transform("rows", pick).alias("rows"))


MANIFEST = "version int, folding boolean, stemmer string, has_content boolean, has_vectors boolean, has_blocks boolean"


def write_index(index: Index, path: str) -> None:
    """Postings and dictionary sorted by term inside files ranged by corpus and term, so a lookup of a few
    terms reads few row groups; content apart from the scored columns; the analyzer beside them."""
    spark = index.postings.sparkSession
    for name in ("postings", "dictionary"):
        df = getattr(index, name)
        df.repartitionByRange("corpus", "term").sortWithinPartitions("corpus", "term").write.mode("overwrite").parquet(f"{path}/{name}")
    for name in ("chunks", "lengths", "stats", "content", "vectors", "blocks"):
        if getattr(index, name) is not None:
            getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(2, index.analyzer.folding, index.analyzer.stemmer, index.content is not None, index.vectors is not None, index.blocks is not None)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_index(spark, path: str) -> Index:
    m = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    if m is None or m.version != 2:
        raise ValueError(f"no index of format 2 at {path}")
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    return Index(read("chunks"), read("postings"), read("dictionary"), read("lengths"), read("stats"), read("content") if m.has_content else None, read("vectors") if m.has_vectors else None, Analyzer(m.folding, m.stemmer), read("blocks") if m.has_blocks else None)


def write_index_v1(postings: DataFrame, lengths: DataFrame, chunks: DataFrame, path: str, vectors: DataFrame | None = None, packed: DataFrame | None = None) -> None:
    """The unfielded format: postings(corpus, term, chunk_ix, tf) sorted by term, lengths, the chunks whole, and
    vectors in single precision; ``packed`` are its blocks, where they are made already."""
    spark = postings.sparkSession
    if packed is not None:
        packed.write.mode("overwrite").parquet(f"{path}/blocks")
    postings.repartitionByRange("corpus", "term").sortWithinPartitions("corpus", "term", "chunk_ix").write.mode("overwrite").parquet(f"{path}/lexical")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    chunks.write.mode("overwrite").parquet(f"{path}/metadata")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([(1, vectors is not None)], "version int, has_vectors boolean").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_index_v1(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Postings, lengths, chunks and vectors of ``write_index_v1``; ``search.unfielded`` ranks over them."""
    m = spark.read.schema("version int, has_vectors boolean").json(f"{path}/manifest").first()
    if m is None or m.version != 1:
        raise ValueError(f"no index of format 1 at {path}")
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    return read("lexical"), read("lengths"), read("metadata"), read("vectors") if m.has_vectors else None


def with_vectors(index: Index, vectors: DataFrame) -> Index:
    return replace(index, vectors=vectors)


def index_faults(index: Index) -> DataFrame:
    """(fault, number) of what a well-formed index must not have; every number is 0 in one."""
    p = index.postings
    tf = F.col("tf_title") + F.col("tf_heading") + F.col("tf_body")
    checks = {
        "posting without occurrence": p.where(tf <= 0),
        "repeated posting": p.groupBy("corpus", "term", "chunk_ix").count().where("count > 1"),
        "posting of an unknown chunk": p.join(index.lengths.select("corpus", "chunk_ix"), ["corpus", "chunk_ix"], "left_anti"),
        "document frequency unlike postings": dictionary_of(p).join(index.dictionary.withColumnRenamed("df", "stored"), ["corpus", "term"], "full").where(~F.col("df").eqNullSafe(F.col("stored"))),
        "term without text": index.dictionary.where("term IS NULL OR length(term) < 1"),
        "repeated term": index.dictionary.groupBy("corpus", "term").count().where("count > 1"),
        "posting with a negative frequency": p.where("tf_title < 0 OR tf_heading < 0 OR tf_body < 0"),
        "repeated chunk": index.chunks.groupBy("corpus", "chunk_ix").count().where("count > 1"),
    }
    if index.vectors is not None:
        dims = index.vectors.groupBy("corpus").agg(F.countDistinct(F.size("embedding")).alias("n"))
        checks["corpus with vectors of several sizes"] = dims.where("n > 1")
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count(F.lit(1)).alias("number")).select(F.lit(name).alias("fault"), "number")
        out = one if out is None else out.unionByName(one)
    return out
