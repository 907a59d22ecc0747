"""Problem 6: cutting oversized texts at natural boundaries (byte-range processing).

A text is handled in ranges of a fixed size, whatever its length: one worker finds the word starts,
boundaries and headings of a range, looking a halo beyond its edges. Word counts of the ranges are added
up, which gives every boundary its place in the text. Pieces are planned over spans of a bounded number of
words, from the boundary tables alone, and each range then emits its share of the pieces that touch it. A
text of one range needs no stitching and is cut where it is read. Ranges of files are read by byte offset,
once for the boundaries and once for the pieces, so no file is ever loaded whole; a text of a table arrives
whole in its row and is sliced once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators.scan import range_layout, running_sum
from lexloom.runtime import materialize, partitions

# Unicode white space, sentence ends, and what may close after them.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0  -     　"
CLOSERS = "\"'”’»›)\\]}"
# Characters (of files: bytes) of a range and of the halo on either side, words of a span, and of the stretches by
# which pieces and ranges find each other.
RANGE, HALO, SPAN, STRETCH = 65_536, 1024, 500_000, 8192
ITEM = ["item_kind", "item_id"]

_START = re.compile(f"(?<![^{WHITE}])[^{WHITE}]")
_END = re.compile(f"[.!?][{CLOSERS}]*(?=[{WHITE}])|\n")
_BLANK = re.compile(f"\n[{WHITE.replace(chr(10), '')}]*$")
_HEADING = re.compile(r"^(?:#{1,6}[ \t]+(.+?)[ \t#]*|={1,6} (.+?) ={1,6}[ \t]*|\\(?:sub)*section\*?\{(.+?)\}.*|<h[1-6][^>]*>(.+?)</h[1-6]>.*)$", re.M)


def plan(first: int, end: int, bounds: list[int], strengths: list[int], limit: int, overlap: int, opens: bool) -> list[tuple[int, int, int, bool]]:
    """Pieces (start, begin of its new words, end, forced) that cover the words ``first`` to ``end``.

    ``bounds`` are word numbers in rising order before which a cut is natural; ``end`` always is. A piece
    begins ``overlap`` words before its new ones, unless it opens the text. A cut is made at the strongest
    boundary in the later half of the room, the last of equal ones. Where no boundary is left in the room
    the overlap is shortened until one is; only if more than ``limit`` words stand between two
    boundaries is the cut forced.
    """
    out, new = [], first
    while new < end:
        start = new if opens and not out else max(0, new - overlap)
        room = start + limit
        if end <= room:
            out.append((start, new, end, False))
            break
        a, b = bisect_right(bounds, new), bisect_right(bounds, room)
        if a < b:
            later = max(a, min(bisect_left(bounds, start + limit // 2), b - 1))
            at = bounds[max(range(later, b), key=lambda k: (strengths[k], k))]
            out.append((start, new, at, False))
        else:
            b = bisect_right(bounds, new + limit)
            at = end if end <= new + limit else bounds[b - 1] if a < b else 0
            if at:
                out.append((max(start, at - limit), new, at, False))
            else:
                at = room
                out.append((start, new, at, True))
        new = at
    return out


def scan(before: str, body: str, after: str) -> tuple[list[int], list[int], list[int], list[int], list[str]]:
    """Of one range: offsets of word starts; boundaries as (words begun before, strength); headings as
    (words begun before, text). Strength 3 is a blank line, 2 a line feed, 1 a sentence end."""
    text, a = before + body + after, len(before)
    b = a + len(body)
    starts = [m.start() - a for m in _START.finditer(text, a, b)] if body else []
    places: list[int] = []
    strengths: list[int] = []
    low = 0
    for m in _END.finditer(text, 0):
        at = m.end() - 1 if m.group() == "\n" else m.end()
        if at < a:
            continue
        if at >= b:
            break
        while low < len(starts) and starts[low] < at - a:
            low += 1
        strength = 1 if m.group() != "\n" else 3 if _BLANK.search(text[max(0, at - HALO) : at]) else 2
        if places and places[-1] == low:
            strengths[-1] = max(strengths[-1], strength)
        else:
            places.append(low)
            strengths.append(strength)
    head = [(bisect_left(starts, m.start() - a), next(g for g in m.groups() if g)) for m in _HEADING.finditer(text) if a <= m.start() < b and (m.start() or not before)]
    return starts, places, strengths, [h[0] for h in head], [re.sub(r"<[^>]+>", "", h[1]).strip() for h in head]


PLACED = "item_kind string, item_id string, heading string, words_limit int, words_overlap int, range_ix int"
PIECE = "item_kind string, item_id string, piece_ix int, heading string, start_word long, new_word long, end_word long, cut string, piece string"
TABLE = f"{PLACED}, n long, places array<long>, strengths array<int>, heads array<long>, titles array<string>"
_EDGE = re.compile(f"[{WHITE}]+$")
# Reads the text of a row: what stands before, in, and after its range.
Load = Callable[[Any], tuple[str, str, str]]


def _overlap(limit: int, overlap: int) -> int:
    return max(0, min(overlap, limit - 1))


def _cut_here(text: str, limit: int, overlap: int, own: str | None) -> list[tuple]:
    """(piece_ix, heading, start, new, end, cut, piece) of a text of one range."""
    starts, places, strengths, heads, titles = scan("", text, "")
    n = len(starts)
    if n <= limit:
        return []
    inner = [(p, s) for p, s in zip(places, strengths, strict=True) if 0 < p < n]
    starts.append(len(text))
    out = []
    for k, (start, new, end, forced) in enumerate(plan(0, n, [p for p, _ in inner], [s for _, s in inner], limit, _overlap(limit, overlap), True)):
        h = bisect_right(heads, new) - 1
        # The text before its first word belongs to the first piece.
        piece = text[starts[start] if start else 0 : starts[end]]
        out.append((k, titles[h] if h >= 0 else own, start, new, end, "forced" if forced else "natural", _EDGE.sub("", piece)))
    return out


def _stitched(placed: DataFrame, load: Load, width: int, span: int) -> DataFrame:
    """Pieces of texts of several ranges. ``placed`` has a row a range, from which ``load`` reads its text;
    ``width`` is the most words that a range can begin."""
    names = [c.split()[0] for c in PLACED.split(", ")]

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [scan(*load(r)) for r in rows.itertuples(index=False)]
            yield rows[names].assign(n=[len(g[0]) for g in got], places=[g[1] for g in got], strengths=[g[2] for g in got], heads=[g[3] for g in got], titles=[g[4] for g in got])

    found = materialize(placed.mapInPandas(tabulate, TABLE), "boundaries")
    laid = range_layout(found.select(*ITEM, "range_ix", "n"), ITEM, ["range_ix"], ready=True)
    offsets = running_sum(laid, ITEM, ["range_ix"], F.col("n"), "upto").select(*ITEM, "range_ix", (F.col("upto") - F.col("n")).alias("offset"))
    large = found.groupBy(*ITEM, "words_limit").agg(F.sum("n").alias("words")).where("words > words_limit").select(*ITEM, "words")
    # A span has at least the words of a range and a piece.
    stride = F.greatest(F.lit(span), F.lit(width) + F.col("words_limit"))
    shift = lambda c: F.transform(c, lambda x: x + F.col("offset"))
    tables = found.join(large, ITEM).join(offsets, [*ITEM, "range_ix"]).select(*names, "offset", "n", "words", F.floor(F.col("offset") / stride).cast("int").alias("span_ix"), F.arrays_zip(shift("places").alias("at"), F.col("strengths").alias("strength")).alias("bounds"), F.arrays_zip(shift("heads").alias("at"), F.col("titles").alias("title")).alias("heads"))
    tables = materialize(tables, "tables")

    # A span's table is bounded by its words. Its pieces run from its first boundary to that of the next span
    # that has one; a span without any belongs to the one before.
    spans = tables.groupBy(*ITEM, "span_ix", "words_limit", "words_overlap", "words").agg(F.min("heading").alias("own_heading"), F.sort_array(F.flatten(F.collect_list("bounds"))).alias("bounds"), F.sort_array(F.flatten(F.collect_list("heads"))).alias("heads"))
    inner = F.filter("bounds", lambda x: (x["at"] > 0) & (x["at"] < F.col("words")))
    spans = materialize(spans.withColumn("bounds", inner).withColumn("from_word", F.when(F.col("span_ix") == 0, F.lit(0)).otherwise(F.get(F.col("bounds.at"), F.lit(0)))), "spans")
    slim = spans.select(*ITEM, "span_ix", "words", "from_word", F.when(F.size("heads") > 0, F.element_at("heads", -1)["title"]).alias("title"))
    by_item = Window.partitionBy(*ITEM).orderBy("span_ix")
    edges = slim.select(*ITEM, "span_ix", F.coalesce(F.first("from_word", True).over(by_item.rowsBetween(1, Window.unboundedFollowing)), F.col("words")).alias("to_word"), F.last("title", True).over(by_item.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    ready = spans.where("from_word IS NOT NULL").join(edges, [*ITEM, "span_ix"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple] = []
            for r in rows.itertuples(index=False):
                own_bounds = [(x["at"], x["strength"]) for x in r.bounds if r.from_word <= x["at"] < r.to_word]
                got = plan(int(r.from_word), int(r.to_word), [x[0] for x in own_bounds], [x[1] for x in own_bounds], r.words_limit, _overlap(r.words_limit, r.words_overlap), r.span_ix == 0)
                places = [x["at"] for x in r.heads]
                for k, (start, new, end, forced) in enumerate(got):
                    h = bisect_right(places, new) - 1
                    title = r.heads[h]["title"] if h >= 0 else r.carried
                    out.append((r.item_kind, r.item_id, r.span_ix, k, start, new, end, "forced" if forced else "natural", title if isinstance(title, str) else r.own_heading))
            yield pd.DataFrame(out, columns=["item_kind", "item_id", "span_ix", "k", "start_word", "new_word", "end_word", "cut", "heading"])

    planned = materialize(ready.mapInPandas(place, "item_kind string, item_id string, span_ix int, k int, start_word long, new_word long, end_word long, cut string, heading string"), "pieces")
    # Pieces and ranges meet by stretches of words; a pair that meets in several counts in the first.
    first = lambda c: F.floor(F.col(c) / STRETCH)
    over = planned.select(*ITEM, F.struct("span_ix", "k", "start_word", "end_word").alias("p"), first("start_word").alias("a"), F.explode(F.sequence(first("start_word"), first("end_word"))).alias("at"))
    near = tables.select(*ITEM, "range_ix", "offset", "n", first("offset").alias("b"), F.explode(F.sequence(first("offset"), F.floor((F.col("offset") + F.col("n")) / STRETCH))).alias("at"))
    met = near.join(over, [*ITEM, "at"]).where((F.col("at") == F.greatest("a", "b")) & (F.col("p.start_word") < F.col("offset") + F.col("n")) & (F.col("p.end_word") >= F.col("offset")))
    touched = met.groupBy(*ITEM, "range_ix", "offset").agg(F.collect_list("p").alias("ps"))
    texts = placed.drop("words_limit", "words_overlap", "heading").join(touched, [*ITEM, "range_ix"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple] = []
            for r in rows.itertuples(index=False):
                before, body, _ = load(r)
                text, a = before + body, len(before)
                starts = [m.start() - a for m in _START.finditer(text, a)]
                for p in r.ps:
                    # The range's characters before its first word start belong to the word begun before.
                    lo = 0 if p["start_word"] < r.offset or p["start_word"] == r.offset == 0 else starts[p["start_word"] - r.offset]
                    e = p["end_word"] - r.offset
                    hi = len(body) if e >= len(starts) else starts[e]
                    if hi > lo:
                        out.append((r.item_kind, r.item_id, p["span_ix"], p["k"], r.range_ix, body[lo:hi]))
            yield pd.DataFrame(out, columns=["item_kind", "item_id", "span_ix", "k", "range_ix", "part"])

    shares = texts.mapInPandas(emit, "item_kind string, item_id string, span_ix int, k int, range_ix int, part string")
    joined = shares.groupBy(*ITEM, "span_ix", "k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range_ix", "part"))), lambda x: x["part"]), "").alias("piece"))
    got = planned.join(joined, [*ITEM, "span_ix", "k"])
    counts = planned.groupBy(*ITEM, "span_ix").agg(F.count(F.lit(1)).alias("c"))
    earlier = counts.select(*ITEM, "span_ix", F.coalesce(F.sum("c").over(by_item.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    got = got.join(earlier, [*ITEM, "span_ix"])
    return got.select(*ITEM, (F.col("earlier") + F.col("k")).cast("int").alias("piece_ix"), "heading", "start_word", "new_word", "end_word", "cut", F.regexp_replace("piece", f"[{WHITE}]+$", "").alias("piece"))


def pieces(items: DataFrame, range_chars: int = RANGE, span: int = SPAN) -> DataFrame:
    """Pieces of the texts of more than ``words_limit`` words: (item_kind, item_id, piece_ix, heading,
    start_word, new_word, end_word, cut, piece).

    ``items(item_kind, item_id, text, heading, words_limit, words_overlap)`` with one row an item. Words
    are runs without white space. A piece holds the words from ``start_word`` up to ``end_word`` with the
    white space between them; those before ``new_word`` repeat the end of the piece before. ``cut`` is
    ``forced`` where it ends inside a run of more words than the limit without a boundary, else
    ``natural``. ``heading`` is the last heading in the text at or before the first new word, else the
    item's own. Null, empty and shorter texts give no rows, as does an empty table.
    """
    known = items.where("text IS NOT NULL AND words_limit > 0")
    short = F.length("text") <= range_chars

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple] = []
            for r in rows.itertuples(index=False):
                own = r.heading if isinstance(r.heading, str) else None
                out += [(r.item_kind, r.item_id, *p) for p in _cut_here(r.text, int(r.words_limit), int(r.words_overlap), own)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                at = range(0, len(r.text), range_chars)
                yield pd.DataFrame({"item_kind": r.item_kind, "item_id": r.item_id, "heading": r.heading, "words_limit": r.words_limit, "words_overlap": r.words_overlap, "range_ix": range(len(at)), "before": [r.text[max(0, k - HALO) : k] for k in at], "body": [r.text[k : k + range_chars] for k in at], "after": [r.text[k + range_chars : k + range_chars + HALO] for k in at]})

    columns = ["item_kind", "item_id", "text", "heading", "words_limit", "words_overlap"]
    one = known.where(short).select(*columns).mapInPandas(whole, PIECE)
    long = known.where(~short)
    if long.isEmpty():
        return one
    cut = materialize(long.select(*columns).mapInPandas(slices, f"{PLACED}, before string, body string, after string"), "textranges")
    return one.unionByName(_stitched(cut, lambda r: (r.before, r.body, r.after), range_chars // 2 + 1, span))


def file_pieces(spark: SparkSession, path: str, words_limit: int, words_overlap: int, range_bytes: int = RANGE, span: int = SPAN) -> DataFrame:
    """``pieces`` of the text files under a path, read by byte ranges; ``item_kind`` is ``file`` and
    ``item_id`` the file's address.

    Only names and lengths are listed beforehand. A character belongs to the range in which its first byte
    stands. Bytes that are not UTF-8 become replacement characters. Empty and shorter files give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    number = F.explode(F.sequence(F.lit(0), ((F.col("length") - 1) / range_bytes).cast("int")))
    placed = files.select(F.lit("file").alias("item_kind"), F.col("path").alias("item_id"), F.lit(None).cast("string").alias("heading"), F.lit(words_limit).alias("words_limit"), F.lit(words_overlap).alias("words_overlap"), number.alias("range_ix"))

    def load(r) -> tuple[str, str, str]:
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(r.item_id)
        a, b = r.range_ix * range_bytes, (r.range_ix + 1) * range_bytes
        low = max(0, a - HALO)
        with where.open_input_file(name) as f:
            raw = f.read_at(b + HALO - low, low)

        def at(k: int) -> int:  # where the first character that begins at byte k or later begins
            k = min(k, len(raw))
            while k < len(raw) and raw[k] & 0xC0 == 0x80 and 0 < k:
                k += 1
            return k

        a, b = at(a - low), at(b - low)
        return tuple(x.decode("utf-8", "replace") for x in (raw[at(0) if low else 0 : a], raw[a:b], raw[b:]))

    # Ranges of one file are spread over all tasks.
    spread = placed.repartition(max(partitions(spark), 1), "item_id", "range_ix")
    return _stitched(spread, load, range_bytes // 2 + 1, span)


def oversized(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The items of both tables over their limits; of repeated rows of an id the latest arrival counts (of
    equal arrivals one over the limit). Rows without id or content are left out. Words are counted before
    the rows of an id meet, so only texts over their limit are shuffled."""

    def latest(df: DataFrame, kind: str, heading: Column, limit: int, overlap: int) -> DataFrame:
        known = df.where("id IS NOT NULL AND content IS NOT NULL")
        over = F.when(F.regexp_count("content", F.lit(f"[^{WHITE}]+")) > limit, F.col("content"))
        rows = known.groupBy("id").agg(F.max(F.struct("ingested_at", over.alias("text"), heading.alias("heading"))).alias("r")).where("r.text IS NOT NULL")
        return rows.select(F.lit(kind).alias("item_kind"), F.col("id").alias("item_id"), "r.text", "r.heading", F.lit(limit).alias("words_limit"), F.lit(overlap).alias("words_overlap"))

    return latest(documents, "document", F.col("title"), 600, 60).unionByName(latest(chunks, "chunk", F.coalesce("heading", "title"), 180, 30))


def item_cuts(planned: DataFrame) -> DataFrame:
    """(item_kind, item_id, cut): ``forced`` if any piece of the item is cut so, else ``natural``."""
    return planned.groupBy(*ITEM).agg(F.min("cut").alias("cut"))
