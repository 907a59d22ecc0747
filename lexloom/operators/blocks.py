"""Batches of queries scored by blocks of whole documents, so that no match of a query and a chunk is shuffled or
written before it is known to be wanted.

The matches of a batch grow with queries times chunks. A block holds the words of some hundred chunks in one row; a
task makes the scores of a block as a matrix of queries by chunks, and keeps of it what was asked for: each query's
best, the first results of each query, counts of facet values, or all scores. What leaves a task grows with the
queries alone, except where all scores are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.scoring import FIELDS, K1, B
from lexloom.functions.text import fold_text

# Chunks a block holds about, queries of one matrix, its cells at most, and rows of terms that a pass brings to the driver.
BLOCK, TILE, CELLS, PASS_TERMS = 256, 1024, 1 << 18, 150_000
# Rows that a task holds before it cuts them to the first of each query, and chunks whose words are Python strings at once.
HELD, SLICE = 1 << 17, 256
WORDS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), *[T.StructField(f"tf_{f}", T.IntegerType()) for f in FIELDS]]))


def count_words(chunks: DataFrame, fields: tuple[str, ...], folding: bool) -> DataFrame:
    """Replaces the columns of token lists (one for each of title, heading and body) by ``words``: the terms longer than
    one character with their counts by field. Every chunk is one row, so nothing is shuffled."""
    rest = [c for c in chunks.columns if c not in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, len(whole), SLICE)):
            ends, names, counts = [0], [], []
            for texts in zip(*[batch.column(f).to_pylist() for f in fields], strict=True):
                found: dict[str, list[int]] = {}
                for k, words in enumerate(texts):
                    for raw in words or ():
                        term = raw
                        if folding and (term := known.get(raw)) is None:
                            if len(known) > 1_000_000:
                                known.clear()
                            term = known[raw] = fold_text(raw)
                        if len(term) > 1:
                            if (own := found.get(term)) is None:
                                own = found[term] = [0, 0, 0]
                            own[k] += 1
                names.extend(found)
                counts.extend(found.values())
                ends.append(len(names))
            tf = np.array(counts, dtype=np.int32).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(names, pa.string()), *[pa.array(tf[:, k]) for k in range(3)]], ["term", *[f"tf_{f}" for f in FIELDS]])
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], words], [*rest, "words"])

    return chunks.mapInArrow(run, T.StructType([*[chunks.schema[c] for c in rest], T.StructField("words", WORDS)]))


def with_lengths(forward: DataFrame) -> DataFrame:
    """Adds ``len_*``, the number of words of each field."""
    total = lambda f: F.aggregate("words", F.lit(0), lambda a, w: a + w[f"tf_{f}"])
    return forward.select("*", *[total(f).alias(f"len_{f}") for f in FIELDS])


def pack(forward: DataFrame, chunks: int) -> DataFrame:
    """(corpus, rows): blocks of ``forward(corpus, chunk_ix, id, document_id, words, ...)``; the chunks of a document are in
    one block, which is the only shuffle. ``chunks`` is the number of chunks."""
    if "len_body" not in forward.columns:
        forward = with_lengths(forward)
    own = [c for c in forward.columns if c != "corpus"]
    number = F.pmod(F.xxhash64("document_id"), F.lit(1 + chunks // BLOCK))
    return forward.groupBy("corpus", number.alias("_b")).agg(F.collect_list(F.struct(*own)).alias("rows")).drop("_b")


def flat(blocks: DataFrame, *columns: str) -> DataFrame:
    """(corpus, the named columns) of every chunk."""
    return blocks.select("corpus", F.explode("rows").alias("r")).select("corpus", *[f"r.{c}" for c in columns])


class Asked:
    """The queries of one pass: by corpus their ids, and tiles of (queries, words of each, terms of each word)."""

    def __init__(self, terms: pd.DataFrame, pairs: pd.DataFrame | None, stats: dict[str, tuple[float, dict[str, float]]], weights: dict[str, float]):
        self.weights = [float(weights[f]) for f in FIELDS]
        self.corpora: dict[str, dict] = {}
        names = set(terms.corpus) | (set() if pairs is None else set(pairs.corpus))
        terms_of = dict(list(terms.groupby("corpus", sort=False)))
        pairs_of = {} if pairs is None else dict(list(pairs.groupby("corpus", sort=False)))
        for name in sorted(names & set(stats)):
            n, average = stats[name]
            t = terms_of.get(name, terms.iloc[:0])
            vocabulary = pd.Index(t.term.unique())
            first = t.drop_duplicates("term")
            weight = dict(zip(first.term, np.log(1 + (n - first.df + 0.5) / (first.df + 0.5)), strict=True))
            code = t.groupby(["source", "prefix"], sort=False).ngroup().to_numpy() if len(t) else np.zeros(0, np.int64)
            one = pd.DataFrame({"word": code, "term": vocabulary.get_indexer(t.term), "boost": t.boost.to_numpy(float), "source": t.source.to_numpy()}).drop_duplicates(["word", "term"])
            expand = {w: (x.term.to_numpy(), x.boost.to_numpy()) for w, x in one.groupby("word", sort=False)}
            uses = pd.DataFrame({"query_id": t.query_id.to_numpy(), "word": code, "at": t.source_ix.to_numpy()}).drop_duplicates(["query_id", "at"])
            slots = uses.groupby("query_id", sort=False)["word"].agg(list).to_dict() if len(uses) else {}
            vector = {}
            if name in pairs_of:
                vector = {i: v for i, v in zip(pairs_of[name].query_id, pairs_of[name].query_vector, strict=True) if v is not None}
            ids = sorted({*slots, *vector}, key=lambda i: (len(vector.get(i, ())), -len(slots.get(i, ()))))
            tiles, at = [], 0
            while at < len(ids):
                size = len(vector.get(ids[at], ()))
                end = at
                while end < len(ids) and end - at < TILE and len(vector.get(ids[end], ())) == size:
                    end += 1
                own = ids[at:end]
                words = sorted({w for i in own for w in slots.get(i, ())}, key=lambda w: -len(expand[w][0]))
                place = {w: k for k, w in enumerate(words)}
                most = max((len(slots.get(i, ())) for i in own), default=0)
                layers = []
                for j in range(most):
                    who = [k for k, i in enumerate(own) if len(slots.get(i, ())) > j]
                    layers.append((np.array(who), np.array([place[slots[own[k]][j]] for k in who])))
                grown = []
                for j in range(max((len(expand[w][0]) for w in words), default=0)):
                    live = [w for w in words if len(expand[w][0]) > j]
                    grown.append((np.array([expand[w][0][j] for w in live]), np.array([expand[w][1][j] for w in live])))
                q = np.stack([np.asarray(vector[i], dtype=np.float64) for i in own]) if size else None
                tiles.append((at, end, layers, grown, q))
                at = end
            self.corpora[name] = {"ids": np.array(ids, dtype=object), "terms": pa.array(vocabulary.astype(object), pa.string()), "idf": np.array([weight[x] for x in vocabulary], dtype=float), "average": max(sum(w * average[f] for w, f in zip(self.weights, FIELDS, strict=True)), 1.0), "tiles": tiles, "top": None, "names": list(vocabulary)}


class Block:
    """One block as arrays, its chunks in order of document and number."""

    def __init__(self, corpus: str, rows: pa.StructArray, asked: Asked, mask: np.ndarray | None):
        own = asked.corpora[corpus]
        order = pc.sort_indices(pa.table({"d": rows.field("document_id"), "c": rows.field("chunk_ix")}), [("d", "ascending"), ("c", "ascending")]).to_numpy()
        if mask is not None:
            self.mask = mask[order]
        else:
            self.mask = None
        self.rows, self.order, self.n = rows, order, len(rows)
        self.chunk_ix = rows.field("chunk_ix").to_numpy(zero_copy_only=False)[order]
        self.documents = rows.field("document_id").take(pa.array(order))
        d = self.documents.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        self.starts = np.concatenate([[0], np.nonzero(np.diff(d))[0] + 1]).astype(np.int64)
        self.ids = rows.field("id").take(pa.array(order))
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        words = rows.field("words")
        ends = words.offsets.to_numpy()
        counts = np.diff(ends)
        inner = words.values.slice(ends[0], ends[-1] - ends[0]) if len(ends) else words.values
        no = pc.fill_null(pc.index_in(inner.field("term"), own["terms"]), -1).to_numpy(zero_copy_only=False)
        chunk = np.repeat(place, counts)
        some = no >= 0
        self.no, self.chunk = no[some], chunk[some]
        tf = sum(w * inner.field(f"tf_{f}").to_numpy(zero_copy_only=False)[some] for w, f in zip(asked.weights, FIELDS, strict=True))
        length = sum(w * rows.field(f"len_{f}").to_numpy(zero_copy_only=False) for w, f in zip(asked.weights, FIELDS, strict=True))[order]
        self.s = own["idf"][self.no] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.chunk] / own["average"]))
        self.present = np.zeros(len(own["terms"]), dtype=bool)
        self.present[self.no] = True
        self.vectors = None
        if "embedding" in [f.name for f in rows.type]:
            self.vectors = rows.field("embedding")

    def matrix(self, asked_terms: int, grown: list) -> np.ndarray:
        """Scores of the words of a tile by chunk: of each word's terms the best."""
        out = np.zeros((len(grown[0][0]) if grown else 0, self.n))
        if len(out):
            used = np.unique(np.concatenate([t for t, _ in grown]))
            used = used[self.present[used]]
            place = np.full(asked_terms, len(used))
            place[used] = np.arange(len(used))
            one = np.zeros((len(used) + 1, self.n))
            at = place[self.no]
            one[at, self.chunk] = self.s
            one[len(used)] = 0
            for t, boost in grown:
                now = one[place[t]]
                now *= boost[:, None]
                np.maximum(out[: len(t)], now, out=out[: len(t)])
        return out

    def cosines(self, q: np.ndarray) -> np.ndarray | None:
        """Cosines of a tile's vectors; NaN where a chunk has no vector of their size."""
        if self.vectors is None:
            return None
        ends, n = self.vectors.offsets.to_numpy(), q.shape[1]
        sizes = np.where(self.vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), -1)[self.order]
        values = self.vectors.values.to_numpy(zero_copy_only=False)
        some = np.nonzero(sizes == n)[0]
        out = np.full((len(q), self.n), np.nan)
        if len(some):
            m = values[ends[:-1][self.order][some][:, None] + np.arange(n)].astype(np.float64)
            norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None]
            out[:, some] = np.divide(q @ m.T, norm, out=np.zeros(norm.shape), where=norm > 0)
        return out


def _tiles(block: Block, own: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(queries by their place, lexical scores, cosines) of the queries that the block can answer."""
    for begin, end, layers, grown, q in own["tiles"]:
        live = np.zeros(end - begin, dtype=bool)
        if q is not None and block.vectors is not None:
            live[:] = True
        elif layers:
            word = np.zeros(len(grown[0][0]), dtype=bool)
            for t, _ in grown:
                word[: len(t)] |= block.present[t]
            for who, slot in layers:
                live[who] |= word[slot]
        if not live.any():
            continue
        v = block.matrix(len(own["terms"]), grown)
        rows = np.nonzero(live)[0]
        step = max(1, CELLS // block.n)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            place = np.full(end - begin, -1)
            place[some] = np.arange(len(some))
            lex = np.zeros((len(some), block.n))
            for who, slot in layers:
                k = place[who]
                lex[k[k >= 0]] += v[slot[k >= 0]]
            yield begin + some, lex, None if q is None else block.cosines(q[some])


def each_block(batches: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[tuple[str, Block, pa.RecordBatch, int]]:
    for batch in batches:
        names = batch.column("corpus").to_pylist()
        rows = batch.column("rows")
        masks = batch.column("_mask") if "_mask" in batch.schema.names else None
        for k, corpus in enumerate(names):
            if corpus in asked.corpora and len(rows[k].values):
                yield corpus, Block(corpus, rows[k].values, asked, None if masks is None else masks[k].values.to_numpy(zero_copy_only=False).astype(bool)), batch, k


def tops(batches: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[pa.RecordBatch]:
    """(corpus, place, top): the best lexical score of each query in each corpus."""
    best = {c: np.zeros(len(own["ids"])) for c, own in asked.corpora.items()}
    for corpus, block, _, _ in each_block(batches, asked):
        for who, lex, _ in _tiles(block, asked.corpora[corpus]):
            best[corpus][who] = np.maximum(best[corpus][who], lex.max(axis=1))
    for corpus, x in best.items():
        some = np.nonzero(x > 0)[0]
        yield pa.RecordBatch.from_arrays([pa.array([corpus] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(x[some])], ["corpus", "place", "top"])


def scores(asked: Asked, kind: pa.DataType) -> Callable:
    """Every positive lexical score, as a batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for corpus, block, _, _ in each_block(batches, asked):
            ids = pa.array(asked.corpora[corpus]["ids"].tolist(), kind)
            for who, lex, _ in _tiles(block, asked.corpora[corpus]):
                a, b = np.nonzero(lex)
                name = pa.array([corpus], pa.string()).take(pa.array(np.zeros(len(a), np.int32)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[a])), name, pa.array(block.chunk_ix[b].astype(np.int32)), pa.array(lex[a, b])], ["query_id", "corpus", "chunk_ix", "lexical_score"])

    return run


def named_scores(asked: Asked, kind: pa.DataType) -> Callable:
    """Every positive score of the unfielded formula with the sorted words that matched, parted by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for corpus, block, _, _ in each_block(batches, asked):
            own = asked.corpora[corpus]
            ids = pa.array(own["ids"].tolist(), kind)
            for begin, end, layers, grown, _ in own["tiles"]:
                held = np.zeros((len(own["terms"]), block.n), dtype=bool)
                held[block.no, block.chunk] = True
                words: list[list[int]] = [[] for _ in range(end - begin)]
                for who, slot in layers:
                    for k, t in zip(who, grown[0][0][slot], strict=True):
                        words[k].append(int(t))
                one = {"tiles": [(begin, end, layers, grown, None)], "terms": own["terms"]}
                for who, lex, _ in _tiles(block, one):
                    a, b = np.nonzero(lex)
                    # Which words matched is a number by row; each one met gets its text once.
                    firsts = np.searchsorted(a, np.arange(len(who) + 1))
                    place, texts = np.empty(len(a), np.int64), []
                    for r, q in enumerate(who):
                        cells = slice(firsts[r], firsts[r + 1])
                        mine = sorted(set(words[q - begin]), key=lambda t: own["names"][t].encode("utf-8", "surrogatepass"))
                        code = np.zeros(firsts[r + 1] - firsts[r], dtype=object if len(mine) > 62 else np.int64)
                        for j, t in enumerate(mine):
                            code = code + held[t, b[cells]].astype(code.dtype) * (1 << j)
                        kinds, at = np.unique(code, return_inverse=True)
                        place[cells] = len(texts) + at
                        texts += [[own["names"][t] for j, t in enumerate(mine) if (int(c) >> j) & 1] for c in kinds]
                    name = pa.array([corpus], pa.string()).take(pa.array(np.zeros(len(a), np.int32)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[a])), name, pa.array(block.chunk_ix[b].astype(np.int32)), pa.array(lex[a, b]), pa.array(texts, pa.list_(pa.string())).take(pa.array(place))], ["query_id", "corpus", "chunk_ix", "score", "terms"])

    return run


def _final(lex: np.ndarray, cos: np.ndarray | None, top: np.ndarray, mode: str, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(score, lexical score by the query's best, semantic score)."""
    lexical = np.divide(lex, top[:, None], out=np.zeros(lex.shape), where=top[:, None] > 0)
    sem = None if cos is None else (cos + 1) / 2
    if mode == "lexical":
        return lexical, lexical, sem
    none = np.ones(lex.shape, dtype=bool) if sem is None else np.isnan(sem)
    if mode == "semantic":
        return np.where(none, 0.0, 0.0 if sem is None else sem), lexical, sem
    w = min(1.0, max(0.0, weight))
    return np.where(none, lexical, lexical * (1 - w) + (0.0 if sem is None else sem) * w), lexical, sem


def _results(block: Block, score: np.ndarray, group: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the results by query, each a document or, ungrouped, a chunk: the rounded score, the number of chunks that
    match, and the level of every chunk (-1 where it does not match)."""
    level = np.where(score > 0, np.round(score, 9), -1.0)
    if block.mask is not None:
        level[:, ~block.mask] = -1.0
    if group == "none":
        return level, (level >= 0).astype(np.int64), level
    return np.maximum.reduceat(level, block.starts, axis=1), np.add.reduceat((level >= 0).astype(np.int64), block.starts, axis=1), level


def _firsts(block: Block, level: np.ndarray, best: np.ndarray, a: np.ndarray, b: np.ndarray, group: str) -> np.ndarray:
    """The place of the first chunk that has the best score of result ``b`` of query ``a``."""
    if group == "none":
        return b
    sizes = np.diff(np.append(block.starts, block.n))
    found = np.full(len(a), -1)
    left = np.arange(len(a))
    step = 0
    while len(left):
        at = block.starts[b[left]] + step
        hit = level[a[left], at] == best[a[left], b[left]]
        found[left[hit]] = at[hit]
        left = left[~hit]
        step += 1
        left = left[sizes[b[left]] > step]
    return found


LISTED = pa.list_(pa.struct([("id", pa.string()), ("score", pa.float64())]))


def pages(asked: Asked, kind: pa.DataType, mode: str, weight: float, group: str, keep: int) -> Callable:
    """The first ``keep`` results of each query in what a task reads, and in a row without id how many there are."""
    names = ["query_id", "corpus", "chunk_ix", "id", "document_id", "score", "lexical_score", "semantic_score", "matches", "chunks", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {c: [] for c in asked.corpora}
        least = {c: np.full(len(own["ids"]), -1.0) for c, own in asked.corpora.items()}
        total = {c: np.zeros(len(own["ids"]), np.int64) for c, own in asked.corpora.items()}
        size = dict.fromkeys(asked.corpora, 0)

        def cut(corpus: str) -> None:
            t = pa.concat_tables(held[corpus])
            t = t.take(pc.sort_indices(t, [("q", "ascending"), ("level", "descending"), ("id", "ascending")]))
            q = t.column("q").to_numpy()
            first = np.searchsorted(q, q)
            rank = np.arange(len(q)) - first
            last = np.nonzero(rank == keep - 1)[0]
            least[corpus][q[last]] = t.column("level").to_numpy()[last]
            held[corpus] = [t.filter(pa.array(rank < keep)).combine_chunks()]
            size[corpus] = len(held[corpus][0])

        for corpus, block, _, _ in each_block(batches, asked):
            own = asked.corpora[corpus]
            top = own["top"]
            for who, lex, cos in _tiles(block, own):
                score, lexical, sem = _final(lex, cos, top[who], mode, weight)
                best, number, level = _results(block, score, group)
                total[corpus][who] += (best >= 0).sum(axis=1)
                if keep == 0:
                    continue
                bar = np.maximum(least[corpus][who], 0.0)
                if keep < best.shape[1] and (least[corpus][who] < 0).any():
                    bar = np.maximum(bar, -np.partition(-best, keep - 1, axis=1)[:, keep - 1])
                a, b = np.nonzero(best >= bar[:, None])
                if not len(a):
                    continue
                at = _firsts(block, level, best, a, b, group)
                picked = pa.array(at)
                listed = pa.nulls(len(a), LISTED)
                if group == "expanded":
                    ends = np.append(block.starts, block.n)
                    texts, lists = block.ids.to_pylist(), []
                    for x, y in zip(a, b, strict=True):
                        cells = np.arange(ends[y], ends[y + 1])
                        cells = cells[level[x, cells] >= 0]
                        cells = cells[np.lexsort((cells, -level[x, cells]))]
                        lists.append([{"id": texts[c], "score": float(score[x, c])} for c in cells])
                    listed = pa.array(lists, LISTED)
                semantic = pa.nulls(len(a), pa.float64()) if sem is None else pa.array(sem[a, at], from_pandas=True)
                held[corpus].append(pa.table({"q": pa.array(who[a].astype(np.int32)), "level": pa.array(best[a, b]), "id": block.ids.take(picked), "chunk_ix": pa.array(block.chunk_ix[at].astype(np.int32)), "document_id": block.documents.take(picked), "score": pa.array(score[a, at]), "lexical_score": pa.array(lexical[a, at]), "semantic_score": semantic, "matches": pa.array(number[a, b]), "chunks": listed}))
                size[corpus] += len(a)
                if size[corpus] > HELD + 2 * keep * len(own["ids"]):
                    cut(corpus)
        for corpus, own in asked.corpora.items():
            ids = pa.array(own["ids"].tolist(), kind)
            some = np.nonzero(total[corpus])[0]
            nulls = lambda n, t: pa.nulls(n, t)
            n = len(some)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array([corpus] * n, pa.string()), nulls(n, pa.int32()), nulls(n, pa.string()), nulls(n, pa.string()), *[nulls(n, pa.float64())] * 3, nulls(n, pa.int64()), nulls(n, LISTED), pa.array(total[corpus][some])], names)
            if held[corpus]:
                cut(corpus)
                t = held[corpus][0]
                for part in t.to_batches(max_chunksize=10_000):
                    m = len(part)
                    yield pa.RecordBatch.from_arrays([ids.take(part.column("q")), pa.array([corpus] * m, pa.string()), *[part.column(c) for c in ("chunk_ix", "id", "document_id", "score", "lexical_score", "semantic_score", "matches", "chunks")], nulls(m, pa.int64())], names)

    return run


def facets(asked: Asked, kind: pa.DataType, mode: str, weight: float, group: str, fields: tuple[str, ...]) -> Callable:
    """(query_id, field, value, number) of the results in what a task reads; ``_values`` holds the values of every chunk
    by field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[tuple[int, str], int]] = {c: {} for c in asked.corpora}
        sums: dict[str, np.ndarray] = {}

        def out(corpus: str) -> pa.RecordBatch:
            ids, labels, m = pa.array(asked.corpora[corpus]["ids"].tolist(), kind), list(known[corpus]), sums.pop(corpus)
            known[corpus].clear()
            a, b = np.nonzero(m)
            field, value = pa.array([fields[f] for f, _ in labels], pa.string()), pa.array([v for _, v in labels], pa.string())
            return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), field.take(pa.array(b)), value.take(pa.array(b)), pa.array(m[a, b].astype(np.int64))], ["query_id", "field", "value", "number"])

        for corpus, block, batch, k in each_block(batches, asked):
            own = asked.corpora[corpus]
            labels, pairs = known[corpus], []
            by_chunk = batch.column("_values")[k].as_py()
            for place, values in enumerate(by_chunk[i] for i in block.order):
                pairs += [(place, labels.setdefault((f, v), len(labels))) for f, many in enumerate(values) for v in many]
            where, what = np.array(pairs, np.int64).reshape(-1, 2).T
            seen, short = np.unique(what, return_inverse=True)
            has = np.zeros((block.n, len(seen)), np.float32)
            has[where, short] = 1
            if corpus not in sums or sums[corpus].shape[1] < len(labels):
                wide = np.zeros((len(own["ids"]), 2 * len(labels)))
                if corpus in sums:
                    wide[:, : sums[corpus].shape[1]] = sums[corpus]
                sums[corpus] = wide
            for who, lex, cos in _tiles(block, own):
                score, _, _ = _final(lex, cos, own["top"][who], mode, weight)
                best, _, level = _results(block, score, group)
                a, b = np.nonzero(best >= 0)
                first = np.zeros(level.shape, np.float32)
                first[a, _firsts(block, level, best, a, b, group)] = 1
                sums[corpus][np.ix_(who, seen)] += first @ has
            if sums[corpus].size > 1 << 23:
                yield out(corpus)
        for corpus in list(sums):
            yield out(corpus)

    return run


def passes(terms: DataFrame | None, pairs: DataFrame | None, stats: DataFrame, weights: dict[str, float], whole: bool = False) -> Iterator[Asked]:
    """The queries in passes whose terms and vectors are bounded on the driver; ``whole``: all in one, be it empty."""
    known = {r.corpus: (r.chunk_count, {f: r[f"avg_{f}"] or 0.0 for f in FIELDS}) for r in stats.collect()}
    count = 0 if terms is None else terms.count()
    if pairs is not None:
        count += pairs.agg(F.coalesce(F.sum(F.size("query_vector")), F.lit(0))).first()[0] // 16
    blocks = 1 if whole else 1 + count // PASS_TERMS
    one = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    for k in range(blocks):
        mine = pd.DataFrame({c: [] for c in ("query_id", "corpus", "source_ix", "source", "prefix", "term", "df", "boost")}) if terms is None else terms.where(one == k).select("query_id", "corpus", "source_ix", "source", "prefix", "term", "df", "boost").toPandas()
        vectors = None if pairs is None else pairs.where(one == k).select("query_id", "corpus", "query_vector").toPandas()
        if whole or len(mine) or (vectors is not None and len(vectors)):
            yield Asked(mine, vectors, known, weights)


def over(blocks: DataFrame, function: Callable, schema: Any) -> DataFrame:
    return blocks.mapInArrow(function, schema)


def shared(spark, asked: Asked, make: Callable[[Asked], Callable]) -> Callable:
    """``make``'s batch function over a broadcast copy of the queries."""
    sent = spark.sparkContext.broadcast(asked)
    return lambda batches: make(sent.value)(batches)


def find_tops(blocks: DataFrame, asked: Asked) -> None:
    """Sets each query's best score by corpus, before any filter."""
    for own in asked.corpora.values():
        own["top"] = np.zeros(len(own["ids"]))
    if not any(len(own["terms"]) for own in asked.corpora.values()):
        return
    run = shared(blocks.sparkSession, asked, lambda a: lambda batches: tops(batches, a))
    got = over(blocks, run, "corpus string, place int, top double").groupBy("corpus", "place").agg(F.max("top").alias("top")).toPandas()
    for corpus, x in got.groupby("corpus"):
        asked.corpora[corpus]["top"][x.place.to_numpy()] = x.top.to_numpy()


def both(asked: tuple[Asked, Asked], kind: pa.DataType) -> Callable:
    """Every positive score of either of two lists of words that a block holds (``words`` and ``words_1``, with the lengths
    ``len_*`` and ``len_1_*``), side by side; null where only the other is positive."""

    def cells(corpus: str, rows: pa.StructArray, own: Asked, places: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        if corpus not in own.corpora:
            return np.zeros(0, np.int64), np.zeros(0), None
        block = Block(corpus, rows, own, None)
        here = np.array([places[i] for i in own.corpora[corpus]["ids"]], np.int64)
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for who, lex, _ in _tiles(block, own.corpora[corpus]):
            a, b = np.nonzero(lex)
            keys.append(here[who[a]] * block.n + b)
            values.append(lex[a, b])
        return np.concatenate(keys), np.concatenate(values), block.chunk_ix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, corpus in enumerate(batch.column("corpus").to_pylist()):
                every = batch.column("rows")[k].values
                ids = list(dict.fromkeys(i for a in asked if corpus in a.corpora for i in a.corpora[corpus]["ids"]))
                if not ids or not len(every):
                    continue
                places = {i: p for p, i in enumerate(ids)}
                names = ["chunk_ix", "id", "document_id", "words", *[f"len_{f}" for f in FIELDS]]
                sides = []
                for a, own in zip(asked, (names, [{"words": "words_1"}.get(c, c.replace("len_", "len_1_")) for c in names]), strict=True):
                    sides.append(cells(corpus, pa.StructArray.from_arrays([every.field(c) for c in own], names), a, places))
                n, chunk_ix = len(every), next(s[2] for s in sides if s[2] is not None)
                keys = np.union1d(sides[0][0], sides[1][0])
                columns = []
                for at, values, _ in sides:
                    column = np.full(len(keys), np.nan)
                    column[np.searchsorted(keys, at)] = values
                    columns.append(pa.array(column, from_pandas=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(keys // n)), pa.array([corpus], pa.string()).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(chunk_ix[keys % n].astype(np.int32)), *columns], ["query_id", "corpus", "chunk_ix", "first", "second"])

    return run
