"""Embeddings: providers, the content-addressed cache, int8 storage, exact similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import scoring
from lexloom.functions.text import provider_directory
from lexloom.operators.scan import range_layout, running_sum

FLOAT_BYTES = 4


@dataclass(frozen=True)
class Provider:
    """Turns texts into vectors of ``dimensions`` numbers; ``embed`` runs on the executors, batch by batch."""

    id: str
    dimensions: int
    embed: Callable[[list[str]], np.ndarray]


def hashing_provider(dimensions: int = 64, name: str = "hashing") -> Provider:
    """A deterministic provider without a model: words hashed to signed places, length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dimensions] += 1 if h >> 63 else -1
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out

    return Provider(f"{name}-{dimensions}", dimensions, embed)


def embed_texts(texts: DataFrame, provider: Provider) -> DataFrame:
    """``texts(key, text)`` -> (key, embedding). Null texts are embedded as empty ones; a provider that
    returns another number of vectors or dimensions is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = np.asarray(provider.embed([t if isinstance(t, str) else "" for t in rows.text]), dtype=np.float32)
            if got.shape != (len(rows), provider.dimensions):
                raise ValueError(f"provider {provider.id} returned {got.shape} for {len(rows)} texts of {provider.dimensions} dimensions")
            yield pd.DataFrame({"key": rows.key, "embedding": list(got)})

    return texts.select("key", "text").mapInPandas(run, "key string, embedding array<float>")


def cache_key(provider: str, text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of provider and text, parted by NUL."""
    return F.substring(F.sha2(F.concat(F.lit(provider), F.lit("\0"), F.coalesce(text, F.lit(""))), 256), 1, 16)


CACHE = "provider string, key string, embedding array<float>, accessed_at timestamp"


def cached_embeddings(texts: DataFrame, provider: Provider, cache: DataFrame, now: Column | None = None, read: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vectors of ``texts(id, text)`` and what to append to the cache: ((id, key, embedding, hit), new rows).

    Only distinct texts that the cache does not hold are embedded, all in one batch job. Entries of another
    provider or another number of dimensions are not used. ``read`` false skips reading but still writes.
    """
    now = F.current_timestamp() if now is None else now
    keyed = texts.withColumn("key", cache_key(provider.id, F.col("text")))
    mine = cache.where((F.col("provider") == provider.id) & (F.size("embedding") == provider.dimensions)).select("key", "embedding").dropDuplicates(["key"])
    if not read:
        mine = mine.limit(0)
    missing = keyed.select("key", "text").dropDuplicates(["key"]).join(mine, "key", "left_anti")
    made = embed_texts(missing, provider)
    both = mine.withColumn("hit", F.lit(True)).unionByName(made.withColumn("hit", F.lit(False)))
    return keyed.join(both, "key").select("id", "key", "embedding", "hit"), made.select(F.lit(provider.id).alias("provider"), "key", "embedding", now.alias("accessed_at"))


def cache_counts(texts: DataFrame, cache: DataFrame, provider: str) -> DataFrame:
    """(texts, hits, misses, embedded): rows, rows in the cache, rows not in it, distinct texts to embed."""
    keyed = texts.select(cache_key(provider, F.col("text")).alias("key"))
    held = cache.where(F.col("provider") == provider).select("key").distinct().withColumn("h", F.lit(1))
    got = keyed.join(held, "key", "left")
    return got.agg(F.count(F.lit(1)).alias("texts"), F.count("h").alias("hits"), F.count(F.when(F.col("h").isNull(), 1)).alias("misses"), F.countDistinct(F.when(F.col("h").isNull(), F.col("key"))).alias("embedded"))


def entry_bytes() -> Column:
    return (F.size("embedding") * FLOAT_BYTES).cast("long")


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries, bytes and last use by provider and, in the row with a null provider, of all."""
    return cache.rollup("provider").agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(entry_bytes()), F.lit(0)).alias("bytes"), F.max("accessed_at").alias("last_used"))


def compact(cache: DataFrame) -> DataFrame:
    """Of repeated entries the one used last."""
    by = Window.partitionBy("provider", "key").orderBy(F.desc_nulls_last("accessed_at"))
    return cache.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def evict(cache: DataFrame, max_bytes: int) -> DataFrame:
    """What stays when the least recently used entries go until at most ``max_bytes`` are left; of equal
    times lower providers and keys go first. The running size is taken over ranges, not in one task."""
    order = ["accessed_at", "provider", "key"]
    sized = compact(cache).withColumn("_b", entry_bytes())
    total = sized.agg(F.sum("_b")).first()[0] or 0
    if total <= max_bytes:
        return sized.drop("_b")
    upto = running_sum(range_layout(sized, [], order), [], order, F.col("_b"), "_upto")
    # An entry goes if what is left before it goes is still too much.
    return upto.where(F.lit(total) - (F.col("_upto") - F.col("_b")) <= max_bytes).drop("_b", "_upto", "_range")


def clear(cache: DataFrame, provider: str | None = None) -> DataFrame:
    return cache.limit(0) if provider is None else cache.where(F.col("provider") != provider)


def cache_path(root: str, provider: str) -> str:
    return f"{root}/{provider_directory(provider)}"


def to_int8(vectors: DataFrame) -> DataFrame:
    """Replaces ``embedding`` by ``scale`` and ``q``, of the vector brought to length 1."""
    unit = vectors.withColumn("_u", scoring.l2_normalize(F.col("embedding"))).withColumn("scale", scoring.quantize_scale(F.col("_u")).cast("float"))
    return unit.withColumn("q", scoring.quantize(F.col("_u"), F.col("scale").cast("double"))).drop("embedding", "_u")


# Bytes of query vectors that one pass over the vectors holds.
PASS_BYTES = 64 << 20


def _passes(queries: DataFrame, pass_bytes: int) -> Iterator[dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]]:
    """The query vectors by corpus and size, in blocks of bounded bytes."""
    asked = queries.where("query_vector IS NOT NULL").select("query_id", "corpus", "query_vector")
    held = asked.agg(F.coalesce(F.sum(F.size("query_vector")), F.lit(0))).first()[0] * 8
    blocks = 1 + held // (pass_bytes // 2)
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toPandas()
        if len(rows):
            packs = rows.groupby([rows.corpus, rows.query_vector.map(len)])
            yield {at: (own.query_id.to_numpy(), np.stack(own.query_vector.to_numpy()).astype(np.float64)) for at, own in packs}


def similarities(vectors: DataFrame, queries: DataFrame, keep: int | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(query_id, corpus, chunk_ix, cosine) of every query vector with all vectors of its corpus.

    ``queries(query_id, corpus, query_vector)``. The queries are broadcast in blocks of about ``pass_bytes``;
    each block is one pass over the vectors, which are neither shuffled nor copied. Vectors of another size
    than the query's and null ones give no row, zero vectors 0. With ``keep`` each batch of vectors gives only
    its best ``keep`` of a query, and what equals the last of them at nine decimals.
    """
    spark = vectors.sparkSession
    rows_of = vectors.where("embedding IS NOT NULL").select("corpus", "chunk_ix", "embedding")
    schema = "query_id long, corpus string, chunk_ix long, cosine double"
    out = None
    for packs in _passes(queries, pass_bytes):
        shared = spark.sparkContext.broadcast(packs)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for (corpus, size), own in rows.groupby([rows.corpus, rows.embedding.map(len)], sort=False):
                    if (corpus, size) not in shared.value:
                        continue
                    ids, asked = shared.value[corpus, size]
                    m = np.stack(own.embedding.to_numpy()).astype(np.float64)
                    norms, chunk_ix = np.linalg.norm(m, axis=1), own.chunk_ix.to_numpy()
                    step = max(1, 4_000_000 // len(m))
                    for s in range(0, len(ids), step):
                        q = asked[s : s + step]
                        n = np.linalg.norm(q, axis=1)[:, None] * norms[None]
                        cos = np.divide(q @ m.T, n, out=np.zeros(n.shape), where=n > 0)
                        if keep is not None and keep < len(m):
                            level = np.round(cos, 9)
                            some = level >= -np.partition(-level, keep - 1, axis=1)[:, keep - 1 : keep]
                        else:
                            some = np.ones(cos.shape, dtype=bool)
                        a, b = np.nonzero(some)
                        yield pd.DataFrame({"query_id": ids[s : s + step][a], "corpus": corpus, "chunk_ix": chunk_ix[b], "cosine": cos[a, b]})

        got = rows_of.mapInPandas(run, schema)
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], schema) if out is None else out


def top_similar(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most similar vectors of every query, of equal cosines the lower chunk first."""
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "corpus", "chunk_ix")
    return similarities(vectors, queries, k).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def vector_faults(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Rows whose vector is null or of another size."""
    return vectors.where(F.col("embedding").isNull() | (F.size("embedding") != dimensions))
