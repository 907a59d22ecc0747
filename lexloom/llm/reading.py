"""Problem 10: reading level of documents (surprisal under n-gram models, isotonic regression).

In every language three trigram models are counted over all texts, of its plain, its middling and its
demanding ones; sentence ends are words of their own, so the length of sentences counts. The labels come
from a published readability formula. For every document the surprisal of each of its words is taken under
the models of all other texts: its own counts are left out. How the surprisals are distributed is fitted to
the labels of all texts, and isotonic regression over all of them maps the fit to a grade. The grade alone
places a document: the formula is a label and otherwise only reported.

Counts stay distributed. Texts are cut in portions; each portion asks for the counts of its own n-grams once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.scan import range_layout, running_sum
from lexloom.runtime import materialize, partitions

# Texts that a language needs for a level of its own, and texts of a group before thirds take its place; words of a
# portion, n-grams whose counts are added together, and words of texts looked up at a time; observations that the next shorter n-gram counts for, and the chance of a word before any is counted.
FEWEST, GROUP, PORTION, BUCKET, SLICE, PRIOR, EVEN = 12, 10, 1 << 19, 1 << 21, 1 << 16, 4.0, 1 / 60_000
EASY, HARD = 6.0, 14.5
# The least LIX of each school year from the 2nd to the 13th, as published for that index.
LIX_YEARS = (10, 15, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56)
MODELS = ("plain", "middling", "demanding")
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
GRADES = "doc_id long, lang string, words int, formula_grade double, " + "".join(f"{m}_mean double, {m}_p50 double, {m}_p90 double, " for m in MODELS) + "grade double"

_FENCE = re.compile(r"^ {0,3}(```|~~~).*?(?:^ {0,3}\1[ \t]*$|\Z)", re.M | re.S)
_ASIDE = re.compile(r"^\s*(?:[-*+•·–]\s|\d{1,3}[.)]\s|\||#|>|\$\$| {4}|\t|={3,}|-{3,})")
_ADDRESS = re.compile(r"\b(?:https?://|www\.)\S+|\S+@\S+\.\w+|(?<!\S)(?:/[\w.-]+){2,}/?")
_END = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s+[\"'“‘(\[]*[^\W\d_a-zß-öø-ÿ]|\s*$)")
_LAST = re.compile(r".*[.!?…][\"'”’)\]]*(?=\s|$)", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_VOWELS = re.compile(r"[aeiouyà-æè-ïò-öø-üÿœ]+")


def prose(text: str) -> list[str]:
    """The running text of a document, a paragraph each: no code, lists, tables, headings or addresses.
    Lines that follow each other are one paragraph, which counts up to its last sentence end."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    out, run = [], []
    for line in [*text.splitlines(), ""]:
        if line and not line.isspace() and not _ASIDE.match(line):
            run.append(_ADDRESS.sub(" ", line) if "/" in line or "@" in line or "www." in line else line)
        elif run:
            m = _LAST.match(" ".join(run))
            if m:
                out.append(m.group())
            run = []
    return out


STOP = "."


class _Syllables(dict):
    def __missing__(self, word: str) -> int:
        n = len(_VOWELS.findall(word))
        if n > 1 and word.endswith("e") and not word.endswith(("le", "ee")):
            n -= 1
        if len(self) > 500_000:
            self.clear()
        self[word] = n = 0 if word == STOP else max(1, n)
        return n


syllables = _Syllables().__getitem__


def measure(text: str | None, lang: str | None) -> tuple[list[str], int, float]:
    """The words of a text's prose, lower-cased, with a stop after each sentence; the number of words; and
    the grade by formula: Flesch-Kincaid for English, the school year of its LIX for other languages; NaN
    without prose."""
    words: list[str] = []
    sentences = 0
    for ln in prose(text or ""):
        at = 0
        for m in _END.finditer(ln):
            words += _WORD.findall(ln[at : m.start()].lower())
            words.append(STOP)
            sentences += 1
            at = m.end()
        words += _WORD.findall(ln[at:].lower())
    n = len(words) - sentences
    if n <= 0:
        return [], 0, float("nan")
    length = n / max(1, sentences)
    if lang == "en":
        return words, n, 0.39 * length + 11.8 * sum(map(syllables, words)) / n - 15.59
    lix = length + 100 * sum(map((6).__lt__, map(len, words))) / n
    return words, n, 1.0 + sum(lix >= x for x in LIX_YEARS)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[np.ndarray], levels: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys, a row an order, of the n-grams that end at each word of the texts, whose words are hashes.
    A start stands before each text's words, with another before it; the last row says which text."""
    sizes = np.array([len(t) + 1 for t in texts])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.repeat(np.arange(len(texts)), sizes)
    words = np.ones(len(text), np.uint64)
    rest = np.ones(len(text), bool)
    rest[at] = False
    words[rest] = np.concatenate(texts)
    one = _mix(words ^ np.array([_hashes[x] for x in levels], np.uint64)[text])
    before = np.roll(one, 1)
    before[at] = one[at]
    two = _mix(before * np.uint64(0x9E3779B97F4A7C15) + one)
    three = _mix(np.roll(two, 1) * np.uint64(0xD6E8FEB86659FD93) + one)
    return np.stack([one, two, three]), text, at


def _totals(levels: list[str]) -> np.ndarray:
    return np.array([_hashes["\x00total " + x] for x in levels], np.uint64)


def _slices(sizes: np.ndarray) -> list[slice]:
    """Texts that follow each other, of about ``SLICE`` words together."""
    ends = (np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, append=-1)) + 1).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]


def counts(texts: list[np.ndarray], levels: list[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, rising, of the n-grams of the texts and of all words of their levels, and how often they occur in each group."""
    sizes, each = np.array([len(t) for t in texts]), [[] for _ in MODELS]
    for c in _slices(sizes):
        keys, text, at = grams(texts[c], levels[c])
        inner = np.ones(len(text), bool)
        inner[at] = False
        for g, own in enumerate(each):
            mine = groups[c][text] == g
            own += [keys[0, mine], keys[1, mine], keys[2, mine & inner]]
    totals = _totals(levels)
    found = [np.unique(np.concatenate(each.pop(0)), return_counts=True) for _ in MODELS]
    keys = np.unique(np.concatenate([*(x for x, _ in found), totals]))
    held = np.zeros((len(keys), len(MODELS)), np.int64)
    for g, (own, n) in enumerate(found):
        held[np.searchsorted(keys, own), g] = n
    np.add.at(held, (np.searchsorted(keys, totals), groups), sizes)
    return keys, held


def surprisals(texts: list[np.ndarray], levels: list[str], groups: np.ndarray, keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """A row a model, a column a word, from the counts ``held`` of the rising ``keys``; each text's own are left
    out. A shorter n-gram weighs as ``PRIOR`` observations in the next longer one."""
    three, text, at = grams(texts, levels)
    n = len(text)
    # Third-order keys at a text's start stand for nothing and are not read below.
    back, each = pd.factorize(three.ravel())
    found = held[np.minimum(np.searchsorted(keys, each), len(keys) - 1)]
    pair = pd.factorize(back + np.tile(text, 3) * len(each))[0]
    own = np.bincount(pair)[pair]
    inner = np.ones(n, bool)
    inner[at] = False
    own = own.reshape(3, n)
    total, sizes = np.searchsorted(keys, _totals(levels)), np.array([len(t) for t in texts])
    out = np.empty((len(MODELS), n - len(texts)))
    for g in range(len(MODELS)):
        mine = groups == g
        one, two, three = np.ascontiguousarray(found[:, g])[back].reshape(3, n) - own * mine[text]
        p = (one + PRIOR * EVEN) / ((held[total, g] - sizes * mine) + PRIOR)[text]
        p[1:] = (two[1:] + PRIOR * p[1:]) / (one[:-1] + PRIOR)
        p[1:] = (three[1:] + PRIOR * p[1:]) / (two[:-1] + PRIOR)
        out[g] = -np.log2(p[inner])
    return out


def distributions(under: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row a text: mean, spread and quantiles of its words' surprisal under each model, and of the
    difference between each two models."""
    pairs = [(i, j) for i in range(len(under)) for j in range(i)]
    values = np.vstack([under, *[under[i] - under[j] for i, j in pairs]])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mean = np.add.reduceat(values, starts, axis=1) / sizes
    std = np.sqrt(np.maximum(0, np.add.reduceat(values**2, starts, axis=1) / sizes - mean**2))
    out = np.empty((len(sizes), len(values), 2 + len(QUANTILES)))
    out[:, :, 0], out[:, :, 1] = mean.T, std.T
    at = np.outer(sizes - 1, QUANTILES)
    low = np.floor(at).astype(np.int64)
    for n, (s, k) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        own = np.sort(values[:, s : s + k], axis=1)
        a, b = own[:, low[n]], own[:, np.minimum(low[n] + 1, k - 1)]
        out[n, :, 2:] = a + (b - a) * (at[n] - low[n])
    return out


def shaped(texts: list[np.ndarray], levels: list[str], groups: np.ndarray, keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """``distributions`` of the ``surprisals`` of texts that have words. About ``SLICE`` words are looked up at
    a time, so that memory does not hold the n-grams of a portion and their surprisals at once."""
    sizes = np.array([len(t) for t in texts])
    return np.concatenate([distributions(surprisals(texts[c], levels[c], groups[c], keys, held), sizes[c]) for c in _slices(sizes)])


def pool(blocks: list[tuple[float, float, float, float]]) -> list[list[float]]:
    """Pools adjacent violators among blocks (sum of y, number, first x, last x) by rising x. Pooling the
    blocks of ranges that follow each other gives what pooling all points gives."""
    out: list[list[float]] = []
    for block in blocks:
        out.append(list(block))
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            s, n, _, last = out.pop()
            out[-1][0] += s
            out[-1][1] += n
            out[-1][3] = last
    return out


def points(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float, float, float]]:
    """A block for each x."""
    at, back, n = np.unique(x, return_inverse=True, return_counts=True)
    return list(zip(np.bincount(back, y, len(at)).tolist(), n.tolist(), at.tolist(), at.tolist(), strict=True))


def steps(blocks: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([v for b in blocks for v in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step function nearest to ``y``, as knots for interpolation."""
    return steps(pool(points(x, y)))


@dataclass
class Level:
    """The fit of a language's distributions to the labels, and the map to grades."""

    centre: np.ndarray
    spread: np.ndarray
    fit: np.ndarray
    knots: np.ndarray | None = None
    grades: np.ndarray | None = None

    @staticmethod
    def fitted(n: float, mean: np.ndarray, scatter: np.ndarray) -> Level:
        """From number, mean and scatter of (distribution, label)."""
        spread = np.sqrt(np.diag(scatter)[:-1] / n) + 1e-9
        zz, zy = scatter[:-1, :-1] / np.outer(spread, spread), scatter[:-1, -1] / spread
        return Level(mean[:-1], spread, np.append(np.linalg.solve(zz + np.eye(len(zz)), zy), n * mean[-1] / (n + 1)))

    def raw(self, shapes: np.ndarray) -> np.ndarray:
        return np.hstack([(shapes - self.centre) / self.spread, np.ones((len(shapes), 1))]) @ self.fit


def together(some: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, mean and scatter about it of all points, from those of parts of them."""
    n = sum(x[0] for x in some)
    mean = sum(x[0] * x[1] for x in some) / n
    return n, mean, sum(s + k * np.outer(m - mean, m - mean) for k, m, s in some)


OTHERS = "\x00others"
# Ids that are null are 0 and marked, since longs with nulls would reach pandas as floats.
MEASURED = "portion long, doc_id long, unnamed boolean, lang string, words int, formula_grade double, tokens binary"
SHAPES = "doc_id long, unnamed boolean, lang string, words int, formula_grade double, level string, shape array<double>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts become Python strings one at a time, and go on with their portion."""
    kinds = {"portion": pa.int64(), "doc_id": pa.int64(), "unnamed": pa.bool_(), "lang": pa.string(), "words": pa.int32(), "formula_grade": pa.float64(), "tokens": pa.binary()}

    def sent(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    portion, room = TaskContext.get().partitionId() << 32, PORTION
    for rows in batches:
        out = []
        for row in zip(*(rows.column(c) for c in ("doc_id", "unnamed", "text", "lang")), strict=True):
            doc_id, unnamed, text, lang = (x.as_py() for x in row)
            words, n, grade = measure(text, lang)
            if len(words) > room:
                portion, room = portion + 1, PORTION
                if out:
                    yield sent(out)
                    out = []
            room -= len(words)
            out.append((portion, doc_id, unnamed, lang, n, grade if n else None, np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)).tobytes()))
        if out:
            yield sent(out)


TIE, NAME = "xxhash64(doc_id, tokens) AS tie", "coalesce(lang, char(0)) AS name"


def _cuts(measured: DataFrame) -> dict[str, tuple | None]:
    """The levels. Groups of texts are those up to ``EASY``, from ``HARD`` on and between; where one would have
    under ``GROUP`` texts they are thirds by (grade, tie), and the first of the second and third are given."""
    prose = measured.where("words > 0").selectExpr(NAME, "formula_grade", TIE)
    held = prose.groupBy("name").agg(F.count(F.lit(1)), F.count_if(F.col("formula_grade") <= EASY), F.count_if(F.col("formula_grade") >= HARD)).collect()
    sizes: dict[str, list[int]] = {}
    for name, *n in held:
        own = sizes.setdefault(name if n[0] >= FEWEST else OTHERS, [0, 0, 0])
        own[:] = [a + b for a, b in zip(own, n, strict=True)]
    sizes = {k: n for k, n in sizes.items() if n[0] >= FEWEST}
    cuts: dict[str, tuple | None] = dict.fromkeys(sizes)
    thirds = {k: n for k, (n, low, high) in sizes.items() if min(low, high, n - low - high) < GROUP}
    if thirds:
        spark = measured.sparkSession
        known = F.broadcast(spark.createDataFrame([(k,) for k in sizes], "name string").withColumn("known", F.lit(True)))
        places = F.broadcast(spark.createDataFrame([(k, max(1, n // 3), n - max(1, n // 3)) for k, n in thirds.items()], "level string, low long, high long"))
        level = prose.join(known, "name", "left").select(F.when(F.col("known"), F.col("name")).otherwise(OTHERS).alias("level"), "formula_grade", "tie")
        order = ["formula_grade", "tie"]
        ranked = running_sum(range_layout(level.join(places, "level"), ["level"], order), ["level"], order, F.lit(1), "rank")
        for r in ranked.where("rank IN (low + 1, high + 1)").orderBy("level", "rank").collect():
            cuts[r.level] = (*(cuts[r.level] or ()), (r.formula_grade, r.tie))
    return cuts


def _group(cuts: tuple | None, grade: float, tie: int) -> int:
    if cuts is None:
        return 0 if grade <= EASY else 2 if grade >= HARD else 1
    return sum((grade, tie) >= c for c in cuts)


def _placed(rows: pd.DataFrame, cuts: dict[str, tuple | None]) -> tuple[list[np.ndarray], list[str], np.ndarray]:
    levels = [x if x in cuts else OTHERS for x in rows.name]
    groups = [_group(cuts[x], g, t) for x, g, t in zip(levels, rows.formula_grade, rows.tie, strict=True)]
    return [np.frombuffer(t, np.uint64) for t in rows.tokens], levels, np.array(groups)


def _by(column: str, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each value of ``column``, whose rows stand together."""
    at, held = None, []
    for rows in batches:
        for x, own in rows.groupby(column, sort=False):
            if x != at and held:
                yield at, pd.concat(held, ignore_index=True)
                held = []
            at = x
            held.append(own)
    if held:
        yield at, pd.concat(held, ignore_index=True)


def _planes(values: np.ndarray) -> bytes:
    """64-bit values, their first bytes together, then their second and so on: small and neighbouring ones compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _joined(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all rows, and a row of counts for each."""
    keys, n = ([_values(x, kind) for x in rows[c]] for c, kind in (("keys", np.uint64), ("held", np.int64)))
    return np.concatenate(keys), np.concatenate([x.reshape(-1, len(MODELS)) for x in n])


def _shaped(measured: DataFrame, cuts: dict[str, tuple | None]) -> DataFrame:
    """``measured`` with each text's level and distributions; null where it has no prose or level."""
    spark = measured.sparkSession
    shared = spark.sparkContext.broadcast(cuts)
    portions, words = measured.agg(F.count_distinct("portion"), F.coalesce(F.sum("words"), F.lit(0))).first()
    buckets = max(partitions(spark), 3 * words // BUCKET)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for portion, rows in _by("portion", batches):
            rows = rows[rows.name.isin(shared.value)] if OTHERS not in shared.value else rows
            if len(rows):
                keys, n = counts(*_placed(rows, shared.value))
                bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                own, first = np.unique(bucket, return_index=True)
                cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))
                yield pd.DataFrame({"bucket": own.astype(np.int64), "portion": portion, "keys": [_planes(keys[a:b]) for a, b in cuts], "held": [_planes(n[a:b]) for a, b in cuts]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _by("bucket", batches):
            keys, n = _joined(rows)
            back, each = pd.factorize(keys)
            sums = np.stack([np.bincount(back, n[:, k], len(each)) for k in range(len(MODELS))], axis=1).astype(np.int64)
            at = np.concatenate([[0], np.cumsum([len(k) // 8 for k in rows["keys"]])]).tolist()
            held = [_planes(sums[back[a:b]]) for a, b in zip(at, at[1:], strict=False)]
            yield pd.DataFrame({"portion": rows.portion, "keys": rows["keys"], "held": held})

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _by("portion", batches):
            asked = rows.doc.to_numpy(dtype=bool)
            docs, held = rows[asked].reset_index(drop=True), rows[~asked]
            docs["level"], docs["shape"] = None, None
            at = np.flatnonzero(((docs.words > 0) & (docs.name.isin(shared.value) | (OTHERS in shared.value))).to_numpy())
            if len(at):
                texts, levels, groups = _placed(docs.iloc[at], shared.value)
                keys, n = _joined(held)
                keys, first = np.unique(keys, return_index=True)
                n = n[first]
                shapes = shaped(texts, levels, groups, keys, n)
                for c, values in (("level", levels), ("shape", shapes.reshape(len(at), -1))):
                    out = np.full(len(docs), None, dtype=object)
                    for k, v in zip(at.tolist(), values, strict=True):
                        out[k] = v
                    docs[c] = out
            yield docs[["doc_id", "unnamed", "lang", "words", "formula_grade", "level", "shape"]]

    named = measured.selectExpr("*", NAME, TIE)
    asked = named.where("words > 0").select("portion", "name", "formula_grade", "tie", "tokens")
    counted = asked.mapInPandas(count, "bucket long, portion long, keys binary, held binary")
    added = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(add, "portion long, keys binary, held binary")
    nothing = {"doc_id": F.lit(0), "unnamed": F.lit(False), "lang": F.lit(None), "name": F.lit(""), "words": F.lit(0), "formula_grade": F.lit(0.0), "tie": F.lit(0), "tokens": F.lit(None)}
    found = added.select(F.lit(False).alias("doc"), "portion", "keys", "held", *[x.alias(c) for c, x in nothing.items()])
    docs = named.select(F.lit(True).alias("doc"), "portion", F.lit(None).alias("keys"), F.lit(None).alias("held"), *nothing)
    met = found.unionByName(docs).repartition(max(partitions(spark), portions), "portion").sortWithinPartitions("portion", "doc")
    return materialize(met.mapInPandas(shape, SHAPES), "shapes")


def _levels(shapes: DataFrame) -> dict[str, Level]:
    """Fits and maps of all levels over all their texts. Partitions send sums of products and pooled blocks."""
    spark = shapes.sparkSession
    known = shapes.where("level IS NOT NULL").select("level", "shape", "formula_grade")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {}
        for rows in batches:
            for level, own in rows.groupby("level"):
                x = np.hstack([np.stack(own["shape"].to_numpy()), own.formula_grade.to_numpy()[:, None]])
                part = (float(len(x)), x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0)))
                held[level] = together([held[level], part]) if level in held else part
        if held:
            yield pd.DataFrame([(level, n, mean, scatter.ravel()) for level, (n, mean, scatter) in held.items()], columns=["level", "n", "mean", "scatter"])

    def parts(rows: pd.DataFrame) -> list[tuple[float, np.ndarray, np.ndarray]]:
        return [(n, np.asarray(mean), np.asarray(scatter).reshape(len(mean), -1)) for n, mean, scatter in zip(rows.n, rows["mean"], rows.scatter, strict=True)]

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = together(parts(rows))
        return pd.DataFrame({"level": rows.level.iloc[:1].to_list(), "n": [n], "mean": [mean], "scatter": [scatter.ravel()]})

    schema = "level string, n double, mean array<double>, scatter array<double>"
    got = known.mapInPandas(moments, schema).groupBy("level").applyInPandas(added, schema).toPandas()
    levels = {level: Level.fitted(*part) for level, part in zip(got.level, parts(got), strict=True)}
    fitted = spark.sparkContext.broadcast(levels)

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for level, own in rows.groupby("level"):
                yield pd.DataFrame({"level": level, "raw": fitted.value[level].raw(np.stack(own["shape"].to_numpy())), "y": own.formula_grade.to_numpy()})

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for rows in batches:
            for level, own in rows.groupby("level"):
                held[level] = pool([*held.get(level, []), *points(own.raw.to_numpy(), own.y.to_numpy())])
        yield pd.DataFrame([(level, *b) for level, blocks in held.items() for b in blocks], columns=["level", "s", "n", "first", "last"])

    laid = materialize(known.mapInPandas(raw, "level string, raw double, y double"), "raw").repartitionByRange(partitions(spark), "level", "raw").sortWithinPartitions("level", "raw")
    blocks = laid.mapInPandas(pooled, "level string, s double, n double, first double, last double").toPandas().sort_values(["level", "first"])
    for level, own in blocks.groupby("level"):
        levels[level].knots, levels[level].grades = steps(pool(list(own[["s", "n", "first", "last"]].itertuples(index=False, name=None))))
    return levels


def graded(documents: DataFrame) -> DataFrame:
    """One row a document: (doc_id, lang, words, formula_grade, mean, median and 90 % point of the surprisal
    under each model, grade), over its whole prose.

    ``documents(doc_id, text, lang)``. Texts without prose, null and empty ones have 0 words and null
    figures. A null language is one of its own. Languages with fewer than ``FEWEST`` texts with prose share
    one level; if that has fewer too, their grade and surprisals are null. An empty table gives no rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), "text", "lang")
    measured = materialize(docs.mapInArrow(_measured, MEASURED), "measured")
    shapes = _shaped(measured, _cuts(measured))
    levels = spark.sparkContext.broadcast(_levels(shapes))
    columns = [c.split()[0] for c in GRADES.split(", ")]
    shown = [0, 2 + QUANTILES.index(0.5), 2 + QUANTILES.index(0.9)]

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = rows[["doc_id", "unnamed", "lang", "words", "formula_grade"]].assign(**dict.fromkeys(columns[4:], np.nan))
            for name, own in rows[rows.level.notna()].groupby("level"):
                level, x = levels.value[name], np.stack(own["shape"].to_numpy())
                out.loc[own.index, columns[4:-1]] = x.reshape(len(x), -1, 2 + len(QUANTILES))[:, : len(MODELS), shown].reshape(len(x), -1)
                out.loc[own.index, "grade"] = np.interp(level.raw(x), level.knots, level.grades)
            yield out

    made = shapes.mapInPandas(grade, GRADES.replace("doc_id long", "doc_id long, unnamed boolean"))
    doc_id = F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id")
    return made.select(doc_id, "lang", "words", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in columns[3:]])


def banded(grades: DataFrame) -> DataFrame:
    """(doc_id, reading_band) of the English texts at either end, by their grade: ``easy`` asks for at most
    about five years, ``hard`` for at least about sixteen; the texts between ask for seven to thirteen, so the
    limits lie in the gaps."""
    english = grades.where("lang = 'en' AND grade IS NOT NULL")
    band = F.when(F.col("grade") < EASY, "easy").when(F.col("grade") > HARD, "hard")
    return english.select("doc_id", band.alias("reading_band")).where("reading_band IS NOT NULL")
