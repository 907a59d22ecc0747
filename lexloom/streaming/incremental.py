"""Incremental builds: document files as a stream, re-indexed and re-embedded by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.functions.text import Analyzer
from lexloom.operators.chunking import chunks, text_sections
from lexloom.operators.index import Index, assemble, field_terms, number_chunks, postings_of
from lexloom.operators.vectors import CACHE, Provider, cached_embeddings
from lexloom.runtime import materialize

DOCUMENTS = "id string, url string, title string, content string, corpus string, updated_at timestamp"


def latest(documents: DataFrame) -> DataFrame:
    """Of repeated documents of a batch the one updated last (at the same time the one that is
    greater by content, title and url); events that arrive together become one build."""
    by = Window.partitionBy("corpus", "id").orderBy(F.desc_nulls_last("updated_at"), F.desc("content"), F.desc("title"), F.desc("url"))
    return documents.where("id IS NOT NULL").withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the shared folder, empty where there is none yet; other faults in reading it are errors."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


POSTINGS = "corpus string, term string, chunk_ix string, tf_title int, tf_heading int, tf_body int, document_id string, generation long"


def apply_batch(batch: DataFrame, generation: int, out: str, provider: Provider | None = None, analyzer: Analyzer = Analyzer()) -> None:
    """Appends the postings of the batch's documents under a generation, and the vectors of chunk texts that
    the cache does not hold. Writing a generation again replaces it, so a repeated batch changes nothing. A
    document that arrives with ``removed`` is taken out of the index from this generation on."""
    spark = batch.sparkSession
    batch = batch.withColumn("removed", F.coalesce("removed", F.lit(False)) if "removed" in batch.columns else F.lit(False))
    last = latest(batch)
    made = chunks(text_sections(last.where("NOT removed").drop("removed")).drop("updated_at"))
    # Sections under equal headings have equal chunk ids, so places name the chunks.
    made = made.withColumn("chunk_ix", F.concat_ws("#", "document_id", "section_ix", "window_ix"))
    owner = made.select("corpus", "chunk_ix", "document_id")
    postings = postings_of(field_terms(made, analyzer)).join(owner, ["corpus", "chunk_ix"])
    named = [c.split()[0] for c in POSTINGS.split(", ")]
    postings.withColumn("generation", F.lit(generation).cast("long")).select(*named[:-1]).write.mode("overwrite").parquet(f"{out}/postings/generation={generation}")
    batch.select(F.lit(generation).cast("long").alias("g"), "corpus", F.col("id").alias("document_id")).distinct().drop("g").write.mode("overwrite").parquet(f"{out}/changes/generation={generation}")
    shown = ["corpus", "chunk_ix", "id", "document_id", "url", "title", "heading", "content"]
    made.select(*shown).write.mode("overwrite").parquet(f"{out}/chunks/generation={generation}")
    if provider is not None:
        cache = stored(spark, f"{out}/cache", CACHE)
        _, new = cached_embeddings(made.select("id", F.col("content").alias("text")), provider, cache)
        new.write.mode("append").parquet(f"{out}/cache")


CHUNKS = "corpus string, chunk_ix string, id string, document_id string, url string, title string, heading string, content string, generation long"


def _current(spark: SparkSession, out: str, table: str, schema: str) -> DataFrame:
    changes = stored(spark, f"{out}/changes", "corpus string, document_id string, generation long")
    last = changes.groupBy("corpus", "document_id").agg(F.max("generation").alias("generation"))
    return stored(spark, f"{out}/{table}", schema).join(last, ["corpus", "document_id", "generation"], "left_semi")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The postings that count: of every document those of its last generation."""
    return _current(spark, out, "postings", POSTINGS)


def current_index(spark: SparkSession, out: str, analyzer: Analyzer = Analyzer()) -> Index:
    """A searchable index of what counts: chunks numbered anew, and the postings that the generations hold,
    without a word being analysed again."""
    named = materialize(_current(spark, out, "chunks", CHUNKS).withColumnRenamed("chunk_ix", "place"), "current")
    chunks_ = materialize(number_chunks(named.drop("generation"), ["document_id", "place"]), "chunks")
    own = chunks_.select("corpus", F.col("place").alias("_place"), F.col("chunk_ix").alias("_ix"))
    counted = current(spark, out).withColumnRenamed("chunk_ix", "_place").join(own, ["corpus", "_place"]).withColumnRenamed("_ix", "chunk_ix")
    return assemble(chunks_, materialize(counted.select("corpus", "term", "chunk_ix", "tf_title", "tf_heading", "tf_body"), "counted"), analyzer)


def watch(spark: SparkSession, source: str, out: str, provider: Provider | None = None, analyzer: Analyzer = Analyzer(), once: bool = True, debounce: str = "1 second") -> StreamingQuery:
    """Follows a folder of Parquet document files. ``once`` handles what is there and stops; otherwise new
    files are taken as they come, those of one ``debounce`` together. The checkpoint beside the output makes each file count once."""
    stream = spark.readStream.schema(DOCUMENTS).parquet(source)

    def apply(batch: DataFrame, generation: int) -> None:
        held = batch.persist()
        try:
            apply_batch(held, generation, out, provider, analyzer)
        finally:
            held.unpersist()

    write = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(apply)
    return (write.trigger(availableNow=True) if once else write.trigger(processingTime=debounce)).start()
