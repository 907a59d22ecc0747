"""Problem 5: the main body of pages (nearest-URL page differencing).

Pages are ordered by host and URL path, so that the pages before and after a page are those whose paths
share most with its own. A page's lines are aligned with those of its nearest pages by longest common
subsequence; a line in one is shared, and the share of the near pages that have it says how much it is the
site's. Shared lines are deleted, and with them what they enclose: boxes they open or fill, and what stands
on the far side of them from the page's own prose. Sentences and headings that a few pages happen to have
in common stay. A page that shares nothing loses nothing.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.scan import PID, range_layout
from lexloom.runtime import partitions

# Pages on either side that a page is held against; the share of them from which on a sentence is the site's,
# and from which on a line frames every page; the share of its own prose that the main part of a page has.
NEAR, SITE, FRAME, MAIN = 48, 0.1, 0.5, 0.8
# Words of a heading without a mark of its own, at most; words of a sentence, at least.
HEADING, SENTENCE = 4, 4
_TAG = re.compile(r"<[^<>]*>")
_HIDDEN = re.compile(r"<(head|script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<![a-zA-Z][^>]*>", re.S | re.I)
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\s]*\)")
_OPEN = re.compile(r"^\s*<(div|section|nav|aside|header|footer|main|article|form|ul|ol|table)\b[^<>]*>\s*$", re.I)
_BOX = re.compile(r"<(/?)(div|section|nav|aside|header|footer|main|article|form)\b[^<>]*>", re.I)
_PRE = re.compile(r"<(/?)pre\b", re.I)
_FENCE = re.compile(r"\s*(?:```|~~~)")
_FORMULA = re.compile(r"<su[bp]\b|<math\b|<code\b|\$\$", re.I)
_END = re.compile(r"[.!?…:;]['\"”’»)\]*_`~]*$")
_HEAD = re.compile(r"<h[1-6]\b|^\s*(?:#{1,6}\s|=+ .* =+\s*$|\\(?:sub)*section)", re.I)
_MARKED = re.compile(r"^\s*(?:[-*+•]\s|\d+[.)]\s|\||>\s|    \S|\\(?:begin|end|item|sub)|<(?:li|dt|dd|tr|td|th)\b)", re.I)
_UNDER = re.compile(r"^\s*(?:={3,}|-{3,})\s*$")
_CRUMB = re.compile(r"\s+(?:»|›|>|/|\||·|→)\s+")
_NAME = re.compile(r"[\w .'’-]+")


def visible_lines(content: str) -> list[str]:
    """The text that each line shows; tags, links' targets and hidden elements are no text."""
    if "<" in content:
        content = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", "", m.group()), content)
    return [" ".join(html.unescape(_LINK.sub(r"\1", _TAG.sub("", ln))).split()) for ln in content.split("\n")]


def line_keys(content: str) -> list[int]:
    """A number for every line: of its visible text in lower case with numbers levelled, or of the tag that
    opens a box or list; 0 for lines with neither."""
    import xxhash

    out = []
    for ln, v in zip(content.split("\n"), visible_lines(content), strict=True):
        text = re.sub(r"\d+", "0", v).casefold() if v else f"<{ln.strip()}" if _OPEN.match(ln) else ""
        out.append((xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) | 1) - 2**63 if text else 0)
    return out


def places(keys: list[int]) -> dict[int, list[int]]:
    """Where each line stands, from the last place to the first; zeros take no part."""
    out: dict[int, list[int]] = {}
    for j in range(len(keys) - 1, -1, -1):
        if keys[j]:
            out.setdefault(keys[j], []).append(j)
    return out


def common(a: list[int], where: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Places in ``a`` and in another page (``where``: its ``places``) of a longest common subsequence.

    Pairs of equal lines are run through once, keeping for every length the chain that ends earliest in
    the other page, so the work grows with the pairs and not with the lines (Hunt and Szymanski).
    """
    ends: list[int] = []  # by length, the least last place in the other page
    cells: list[int] = []  # by length, the step that reached it
    steps: list[tuple[int, int, int]] = []
    for i, s in enumerate(a):
        for j in where.get(s, ()):
            n = len(ends) if not ends or ends[-1] < j else bisect_left(ends, j)
            steps.append((i, j, cells[n - 1] if n else -1))
            ends[n : n + 1] = [j]
            cells[n : n + 1] = [len(steps) - 1]
    out, at = [], cells[-1] if cells else -1
    while at >= 0:
        i, j, at = steps[at]
        out.append((i, j))
    return out[::-1]


def _slug(text: str) -> str:
    return re.sub(r"[\W_]+", "-", text.casefold()).strip("-")


class Page:
    """A page's lines, what each is, and in how many of the ``met`` pages it has its match."""

    def __init__(self, content: str, path: str, title: str | None, shared: dict[int, int], met: int) -> None:
        self.lines, self.seen, self.shared, self.met = content.split("\n"), visible_lines(content), shared, met
        self.texts = [k for k, v in enumerate(self.seen) if v]
        slug = path.rstrip("/").rsplit("/", 1)[-1]
        self.names = {_slug(slug), _slug(re.sub(r"-[^-]*$", "", slug)), _slug(visible_lines(title)[0] if title else "")} - {""}
        self.code = self._code()
        self.boxes, self.around = self._boxes()
        self.sentences = {k for k in self.texts if _END.search(self.seen[k]) and len(self.seen[k].split()) >= SENTENCE}
        self.prose = {k for k in self.sentences if k not in self.code and not self.site(k)}

    def _code(self) -> set[int]:
        out, deep, fenced = set(), 0, False
        for k, ln in enumerate(self.lines):
            marks = [m.group(1) for m in _PRE.finditer(ln)] if "<" in ln else []
            fence = bool(_FENCE.match(ln))
            if deep or marks or fenced or fence:
                out.add(k)
            for m in marks:
                deep = max(0, deep + (-1 if m else 1))
            fenced ^= fence
        return out

    def _boxes(self) -> tuple[dict[int, list[int]], list[list[int]]]:
        """The text lines of every box, by the line that opens it, and of every line the boxes around it."""
        boxes: dict[int, list[int]] = {}
        around: list[list[int]] = []
        stack: list[int] = []
        for k, ln in enumerate(self.lines):
            marks = [m.group(1) for m in _BOX.finditer(ln)] if "<" in ln else []
            opened = bool(marks and _OPEN.match(ln))
            if opened:
                stack.append(k)
            around.append(list(stack))
            if self.seen[k]:
                for at in stack:
                    boxes.setdefault(at, []).append(k)
            for _ in range(sum(map(bool, marks)) - (len(marks) - sum(map(bool, marks))) + opened):
                if stack:
                    stack.pop()
        return boxes, around

    def sentence(self, k: int) -> bool:
        return k in self.sentences

    def site(self, k: int, share: float = SITE) -> bool:
        """Whether so many near pages have the line that it is the site's; one page alone shows that only
        where few were met."""
        return self.shared.get(k, 0) >= max(2 if self.met >= 8 else 1, share * self.met)

    def own(self, k: int) -> bool:
        """A sentence of the page's own prose."""
        return k in self.prose

    def titled(self, k: int) -> bool:
        return _slug(self.seen[k]) in self.names and not _CRUMB.search(self.seen[k])

    def heading(self, k: int) -> bool:
        return bool(_HEAD.search(self.lines[k])) or self.titled(k)

    def marked(self, k: int) -> bool:
        """Code, formulas, items of lists and tables, quotes: content that pages may have in common."""
        return k in self.code or bool(_MARKED.match(self.lines[k]) or _FORMULA.search(self.lines[k]))

    def beside(self, k: int) -> tuple[str, str]:
        return self.lines[k - 1] if k else "", self.lines[k + 1] if k + 1 < len(self.lines) else ""

    def weight(self, ks: list[int]) -> int:
        return sum(len(self.seen[k]) for k in ks if k in self.prose)


def _shared_boxes(p: Page) -> set[int]:
    """Lines of boxes without own prose that a shared line opens, begins, ends or half fills, and of boxes
    that a shared line opens beside the one with most of the page's prose."""
    out: set[int] = set()
    for at, held in p.boxes.items():
        met = sum(k in p.shared for k in held)
        enclosed = at in p.shared or 2 * met >= len(held) or met and (held[0] in p.shared or held[-1] in p.shared)
        if enclosed and (met or at in p.shared) and not any(p.own(k) or k in p.code or _FORMULA.search(p.lines[k]) for k in held):
            out |= set(held)
    whole = p.weight(p.texts)
    main = max((at for at, held in p.boxes.items() if whole and p.weight(held) >= MAIN * whole), default=None)
    if main is not None:
        over, inside = {a for a in p.around[p.boxes[main][0]] if a <= main}, set(p.boxes[main])
        for at, held in p.boxes.items():
            if at in p.shared and at not in over and not inside.intersection(held):
                out |= set(held)
    return out


def _outside_frames(p: Page, gone: set[int]) -> set[int]:
    """Lines cut off from the page's prose by lines that frame every page."""
    frames = [k for k in p.texts if p.site(k, FRAME) and p.shared[k] > 1 and not (p.sentence(k) or p.heading(k) or p.marked(k))]
    edges = [-1, *frames, len(p.lines)]
    spans = [[k for k in p.texts if a < k < b and k not in gone] for a, b in zip(edges, edges[1:], strict=False)]
    best = max(spans, key=p.weight)
    if not frames or not best or p.weight(best) < MAIN * p.weight(p.texts):
        return set()
    return {k for k in p.texts if k < best[0] or k > best[-1]}


def _opening(p: Page, left: list[int], first: int) -> int:
    """Where the body begins: at its title, else at the first heading or content before its prose."""
    top = [k for k in left if k < first]
    for k in top:
        if p.titled(k):
            return k
    for k in top:
        if p.heading(k) or p.marked(k) and k not in p.shared:
            return k
        _, after = p.beside(k)
        opens = not after.strip() or _UNDER.match(after) or k + 1 == first and k not in p.shared
        if opens and "</" not in "".join(p.lines[k : k + 2]) and not p.site(k) and not _LINK.match(p.lines[k].strip()) and len(_CRUMB.split(p.seen[k])) < 3:
            return k
    return first


def boilerplate(content: str, path: str, title: str | None, shared: dict[int, int], met: int) -> list[int]:
    """Numbers of the visible lines that are not of the main body. ``shared``: in how many of the ``met``
    pages that it was held against a line has its match. Without shared lines there are none."""
    if not shared:
        return []
    p = Page(content, path, title, shared, met)
    out = _shared_boxes(p)
    if not p.texts:
        return []
    out |= _outside_frames(p, out)
    left = [k for k in p.texts if k not in out]
    body = [k for k in left if p.own(k)]
    if not body:
        return sorted(out | {k for k in left if k in shared and not p.heading(k)})
    begin, last = _opening(p, left, body[0]), body[-1]
    last = max([last, *(k for k in left if k in p.code or p.marked(k) and k not in shared)])
    # What stands before or after the body goes where a shared line stands there.
    for outer in ([k for k in p.texts if k < begin], [k for k in p.texts if k > last and not _UNDER.match(p.lines[k])]):
        if any(k in shared for k in outer):
            out |= set(outer)
    for k in left:
        before, after = p.beside(k)
        bare = len(p.seen[k].split()) <= HEADING and _NAME.fullmatch(p.seen[k]) and not (before.strip() and after.strip())
        kept = p.heading(k) or p.marked(k) or bare or _UNDER.match(after) or _UNDER.match(p.lines[k])
        if begin <= k <= last and k in shared and (p.site(k) if p.sentence(k) else True) and not kept:
            out.add(k)
    return sorted(out)


def differenced(documents: DataFrame, near: int = NEAR) -> DataFrame:
    """(id, boilerplate array<int>, body): per page the lines outside its main body, and the body.

    ``documents(id, url, title, content, ingested_at)``; pages are rows with an absolute http(s) URL and
    content. Of repeated rows of an id the last to arrive counts. A page alone on its host, or with
    nothing in common with those near it, keeps all its lines; a page without visible lines has no
    boilerplate. An empty table gives no rows.
    """

    @F.pandas_udf("array<long>")
    def keys(contents: pd.Series) -> pd.Series:
        return contents.map(line_keys)

    pages = documents.where(F.col("id").isNotNull() & F.col("content").isNotNull() & F.col("url").rlike("(?i)^https?://[^/]"))
    pages = pages.groupBy("id").agg(F.max(F.struct("ingested_at", "url", "title", "content")).alias("p")).select("id", "p.url", "p.title", "p.content")
    pages = pages.withColumn("host", F.lower(F.regexp_extract("url", r"(?i)^https?://([^/?#]+)", 1))).withColumn("path", F.regexp_extract("url", r"(?i)^https?://[^/]+([^?#]*)", 1))
    order = ["host", "path", "id"]
    # Ranges hold several times the pages that their neighbours are shown, where there are enough.
    parts = partitions(documents.sparkSession)
    ranges = max(1, min(parts, documents.count() // (4 * near)))
    laid = range_layout(pages.select("id", "host", "path", "title", "content", keys("content").alias("keys")), [], order, ranges)
    # The first and last pages of every range are also shown, as numbers, to the ranges beside it.
    up = F.row_number().over(Window.partitionBy(PID).orderBy(*order))
    down = F.row_number().over(Window.partitionBy(PID).orderBy(*[F.col(c).desc() for c in order]))
    edges = laid.select(*order, "keys", PID).withColumn("u", up).withColumn("d", down).where((F.col("u") <= near) | (F.col("d") <= near))
    moves = F.filter(F.array(F.when(F.col("u") <= near, F.col(PID) - 1), F.when(F.col("d") <= near, F.col(PID) + 1)), lambda x: x.isNotNull())
    empty = F.lit(None).cast("string")
    shown = edges.select("id", "host", "path", empty.alias("title"), empty.alias("content"), "keys", F.explode(moves).alias(PID), F.lit(False).alias("own"))
    met = laid.withColumn("own", F.lit(True)).unionByName(shown).where(F.col(PID) >= 0).repartitionById(parts, F.col(PID)).sortWithinPartitions(PID, *order)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window: deque = deque()  # pages of one range and host in order, with their lines and what they share
        out: list[tuple] = []
        at = None

        def done(p: list) -> None:
            row, _, shared, met = p
            if row.own:
                drop = boilerplate(row.content, row.path, row.title, shared, met)
                gone = set(drop)
                body = "\n".join(x for k, x in enumerate(row.content.split("\n")) if k not in gone)
                out.append((row.id, drop, body))

        for rows in batches:
            rows.columns = [c if c != PID else "part" for c in rows.columns]
            for row in rows.itertuples(index=False):
                if (row.part, row.host) != at:
                    while window:
                        done(window.popleft())
                    at = row.part, row.host
                page = [row, row.keys.tolist(), {}, 0]
                where, mine = places(page[1]), page[2]
                for other in window:
                    if row.own or other[0].own:
                        other[3] += 1
                        page[3] += 1
                        theirs = other[2]
                        for i, j in common(other[1], where):
                            theirs[i] = theirs.get(i, 0) + 1
                            mine[j] = mine.get(j, 0) + 1
                window.append(page)
                if len(window) > near:
                    done(window.popleft())
            yield pd.DataFrame(out, columns=["id", "boilerplate", "body"])
            out.clear()
        while window:
            done(window.popleft())
        yield pd.DataFrame(out, columns=["id", "boilerplate", "body"])

    return met.mapInPandas(align, "id string, boilerplate array<int>, body string")
