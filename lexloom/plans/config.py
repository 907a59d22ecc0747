"""Builds from a configuration: corpora with their sources, routes, chunking, fields and vectors -> an index folder."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.scoring import dequantize
from lexloom.functions.text import Analyzer, route_matches, safe_name
from lexloom.operators.chunking import MAX_WORDS, OVERLAP, chunks, text_sections
from lexloom.operators.index import Index, build_index, number_chunks, read_index, read_index_v1, unfielded_postings, write_index, write_index_v1
from lexloom.operators.vectors import CACHE, Provider, cached_embeddings, embed_texts, to_int8
from lexloom.runtime import materialize, pinned
from lexloom.sources.documents import load_documents
from lexloom.sources.store import clean_corpus, locked, read_manifest, remove_stale, write_manifest
from lexloom.streaming.incremental import stored

MODES = ("lexical", "semantic", "hybrid")


@dataclass(frozen=True)
class Vectors:
    """``static`` vectors are made by the build and stored, as bytes where ``int8``; ``runtime`` ones are made
    when a search first needs them."""

    provider: Provider
    mode: str = "static"
    int8: bool = True


@dataclass(frozen=True)
class Corpus:
    """One searchable collection: where its documents come from, which routes it takes, how they are cut, which
    metadata fields filters and facets use (the others stay with the content), and how words become terms."""

    source: Any = None
    options: Mapping[str, Any] = field(default_factory=dict)
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_words: int = MAX_WORDS
    overlap: int = OVERLAP
    filters: tuple[str, ...] = ()
    facets: tuple[str, ...] = ()
    analyzer: Analyzer = Analyzer()
    vectors: Vectors | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(sorted({*self.filters, *self.facets}))

    @property
    def modes(self) -> tuple[str, ...]:
        return MODES if self.vectors else MODES[:1]


_providers: dict[str, Provider] = {}


def register_provider(provider: Provider) -> None:
    """A provider that configuration files may name by its id."""
    _providers[provider.id] = provider


def load_config(spark: SparkSession, path: str) -> dict[str, Corpus]:
    """The corpora of a JSON file ``{"corpora": {name: {...}}}``: ``source`` (a path or ``@adapter``; none reads
    rendered HTML below ``options.root``), ``options``, ``include``, ``exclude``, ``max_words``, ``overlap``,
    ``filters``, ``facets``, ``folding``, ``stemmer`` and ``vectors`` (``provider``, ``mode``, ``int8``).

    No corpora, a setting that is not known, and a provider that is not registered are errors."""
    read = json.loads(spark.read.text(path, wholetext=True).first()[0])
    named = read.get("corpora") if isinstance(read, dict) else None
    if not isinstance(named, dict) or not named:
        raise ValueError(f"no corpora in {path}")
    out = {}
    for name, given in named.items():
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
        analyzer = Analyzer(own.pop("folding", True), own.pop("stemmer", None))
        vectors = own.pop("vectors", None)
        if vectors and vectors["provider"] not in _providers:
            raise ValueError(f"no provider {vectors['provider']!r} is registered")
        unknown = set(own) - {f.name for f in fields(Corpus)}
        if unknown:
            raise ValueError(f"corpus {name!r} has unknown settings {sorted(unknown)}")
        out[safe_name(name)] = Corpus(**own, analyzer=analyzer, vectors=Vectors(**{**vectors, "provider": _providers[vectors["provider"]]}) if vectors else None)
    return out


def build_site(spark: SparkSession, site: str, out: str, name: str = "site", **settings) -> dict[str, dict[str, int]]:
    """What runs after a site generator: the index of the pages it rendered below ``site``."""
    return build(spark, {name: Corpus(None, {"root": site}, **settings)}, out)


def corpus_chunks(spark: SparkSession, name: str, corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """The corpus' documents and its numbered chunks, with a column for each filter and facet field and the
    rest of the metadata in ``metadata``. Sources that come in sections already are cut as they are."""
    loaded = load_documents(spark, corpus.source, **corpus.options)
    loaded = loaded.where(route_matches(F.col("url"), list(corpus.include) or None, list(corpus.exclude) or None))
    metadata = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if "metadata" in loaded.columns else F.create_map().cast("map<string,string>")
    loaded = loaded.withColumn("metadata", metadata)
    sections = loaded.withColumn("content", F.lit("")) if "section" in loaded.columns else text_sections(loaded)
    cut = chunks(sections, corpus.max_words, corpus.overlap).withColumn("corpus", F.lit(name))
    for f in corpus.columns:
        cut = cut.withColumn(f, F.col("metadata")[f])
    own = list(corpus.columns)
    cut = cut.withColumn("metadata", F.map_filter("metadata", lambda k, _: ~k.isin(own)) if own else F.col("metadata"))
    return loaded, number_chunks(cut, ["document_id", "section_ix", "window_ix"])


def embedded(spark: SparkSession, cut: DataFrame, vectors: Vectors, cache: str | None) -> tuple[DataFrame, dict[str, int]]:
    """Vectors (corpus, chunk_ix, embedding) of chunks, and how many texts the cache held and were embedded.
    New vectors are added to the cache under a lock, so that builds at the same time do not write over each other."""
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("heading", F.lit("")), F.coalesce("content", F.lit("")))
    texts = cut.select(F.concat_ws("#", "corpus", F.col("chunk_ix").cast("string")).alias("id"), text.alias("text"))
    with locked(spark, f"{cache}/lock" if cache else None):
        held = stored(spark, f"{cache}/entries", CACHE) if cache else spark.createDataFrame([], CACHE)
        got, new = cached_embeddings(materialize(texts, "texts"), vectors.provider, held)
        got, new = materialize(got, "vectors"), materialize(new, "embedded")
        if cache:
            new.write.mode("append").parquet(f"{cache}/entries")
    made = got.select(F.substring_index("id", "#", -1).cast("int").alias("chunk_ix"), F.expr("substring(id, 1, length(id) - length(substring_index(id, '#', -1)) - 1)").alias("corpus"), "embedding")
    return made, {"cached": got.where("hit").count(), "embedded": new.count()}


def build(spark: SparkSession, corpora: Mapping[str, Corpus], out: str, version: int = 2, cache: str | None = None, built_at: str | None = None) -> dict[str, dict[str, int]]:
    """Builds every corpus into a folder of its own below ``out``, removes folders of corpora that are no longer
    configured, and writes the manifest last. Gives documents, chunks, cached and embedded texts by corpus.

    ``version`` 1 writes the unfielded format, 2 the fielded one. A corpus without documents gives an empty
    index; a name that is no folder name, or an unknown version, is an error before anything is written.
    """
    if version not in (1, 2):
        raise ValueError(f"unknown index format {version!r}")
    names = [safe_name(n) for n in corpora]
    remove_stale(spark, out, names)
    counts: dict[str, dict[str, int]] = {}
    for name, corpus in corpora.items():
        loaded, numbered = corpus_chunks(spark, name, corpus)
        cut = materialize(numbered, "chunks")
        stats = {"documents": loaded.select("id").distinct().count(), "chunks": cut.count(), "cached": 0, "embedded": 0}
        made = None
        if corpus.vectors and corpus.vectors.mode == "static":
            made, spent = embedded(spark, cut, corpus.vectors, cache)
            stats.update(spent)
            made = to_int8(made) if corpus.vectors.int8 and version == 2 else made
        clean_corpus(spark, out, name)
        if version == 1:
            write_index_v1(*unfielded_postings(cut), cut, f"{out}/{name}", made)
        else:
            index = build_index(cut, corpus.analyzer, corpus.columns)
            content = cut.select("corpus", "chunk_ix", "content", "metadata")
            write_index(replace(index, content=content, vectors=made), f"{out}/{name}")
        counts[name] = stats
    write_manifest(spark, out, counts, built_at, version)
    return counts


def built_chunks(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The chunks of a built corpus with their content, of either format."""
    if read_manifest(spark, out)["version"] == 1:
        return read_index_v1(spark, f"{out}/{name}")[2]
    index = read_index(spark, f"{out}/{name}")
    return index.chunks.join(index.content, ["corpus", "chunk_ix"])


class Searcher:
    """The corpora of an index folder, each loaded when it is first searched or asked for.

    ``providers`` makes, by corpus, runtime vectors: for the chunks when a search first needs them (or at
    ``warmup``), kept as a table from then on.
    """

    def __init__(self, spark: SparkSession, out: str, providers: Mapping[str, Provider] | None = None) -> None:
        manifest = read_manifest(spark, out)
        if manifest["version"] != 2:
            raise ValueError("only indexes of format 2 can be searched here; see read_index_v1")
        self.spark, self.out, self.providers = spark, out, dict(providers or {})
        self.names = sorted(manifest["corpora"])
        self._open: dict[str, Index] = {}

    def loaded(self, name: str) -> bool:
        return name in self._open

    def load(self, name: str) -> Index:
        if name not in self.names:
            raise ValueError(f"no corpus {name!r}")
        if name not in self._open:
            index = read_index(self.spark, f"{self.out}/{name}")
            if index.vectors is not None and "q" in index.vectors.columns:
                index = replace(index, vectors=index.vectors.select("corpus", "chunk_ix", dequantize(F.col("q"), F.col("scale")).alias("embedding")))
            self._open[name] = index
        return self._open[name]

    def warmup(self, names: tuple[str, ...] = ()) -> None:
        """Loads the corpora and makes the runtime vectors they lack."""
        for name in names or tuple(self.names):
            index = self.load(name)
            if index.vectors is None and name in self.providers:
                text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("heading", F.lit("")), F.coalesce("content", F.lit("")))
                keyed = index.chunks.join(index.content, ["corpus", "chunk_ix"]).select(F.col("chunk_ix").cast("string").alias("key"), text.alias("text"))
                made = pinned(lambda keyed=keyed, name=name: materialize(embed_texts(keyed, self.providers[name]), "runtime"))
                self._open[name] = replace(index, vectors=made.select(F.lit(name).alias("corpus"), F.col("key").cast("int").alias("chunk_ix"), "embedding"))

    def index(self, names: tuple[str, ...] = (), vectors: bool = False) -> Index:
        """Several corpora as one index; with ``vectors`` those that runtime providers make are made first.
        Corpora whose words become terms in different ways cannot be searched together."""
        names = names or tuple(self.names)
        if vectors:
            self.warmup(names)
        parts = [self.load(n) for n in names]
        if len({p.analyzer for p in parts}) > 1:
            raise ValueError("corpora with different analyzers are searched one by one")

        def joined(part: str) -> DataFrame | None:
            some = [x for p in parts if (x := getattr(p, part)) is not None]
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some) if some else None

        return Index(*[joined(c) for c in ("chunks", "postings", "dictionary", "lengths", "stats", "content", "vectors")], parts[0].analyzer, joined("blocks") if len({p.blocks and p.blocks.schema.json() for p in parts}) == 1 else None)
