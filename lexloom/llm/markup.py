"""Problem 4: markup residue (HTML, Markdown, wiki, LaTeX) turned into clean text.

Structure survives in one plain form: headings as ``# ...`` lines, list items as ``- ...``, code in
``` fences, formulas between dollar signs. The kinds of markup of a text are those of which its conversion
met a construct. HTML pages are first cleared by a site style tree: the pages of a host are merged by
element path; for every element the entropy of its make-up over the pages, and the spread of what it says,
give its importance, to which its descendants add theirs; branches of low importance are removed.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.skew import skew_join
from lexloom.runtime import materialize

# HTML element names, names that only wiki text gives tags, and Python's special names.
ELEMENTS = "a abbr address article aside audio b bdi bdo blockquote body br button canvas caption center cite code col colgroup data dd del details dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark menu meta nav noscript object ol optgroup option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
WIKI_ELEMENTS = "math nowiki ref references gallery"
SPECIAL = "init next main name iter call file all doc str repr len new del enter exit getitem setitem hash eq ne lt le gt ge add sub mul bool contains getattr setattr slots dict class module version path future"
_NAMES = "|".join(sorted([*ELEMENTS.split(), *WIKI_ELEMENTS.split()], key=len, reverse=True))

@dataclass(frozen=True)
class Rule:
    """A construct and what becomes of it. ``kind`` is noted where it is met; a rule without one only helps
    where its ``after`` was met. ``needs``: characters of which the text holds at least one."""

    kind: str
    needs: str
    pattern: re.Pattern
    make: str | Callable[[re.Match], str]
    after: str = ""
    whole: bool = False  # until nothing changes any more, for constructs inside each other


def _rule(kind: str, needs: str, pattern: str, make: str | Callable[[re.Match], str], flags: int = 0, after: str = "", whole: bool = False) -> Rule:
    return Rule(kind, needs, re.compile(pattern, flags), make, after, whole)


def _same(m: re.Match) -> str:
    return m.group()


def _code(m: re.Match) -> str:
    return "```\n" + m.group(2).strip("\n") + "\n```"


def _formula(m: re.Match) -> str:
    return "$" + " ".join(next(g for g in m.groups() if g).split()) + "$"


M, S, I = re.M, re.S, re.I
# Taken out first and put back at the end as they are: addresses and drive paths, in which nothing is markup.
_URL = re.compile(r"https?://\S+|\b[A-Za-z]:\\\S+")
# Taken out next and put back converted.
KEPT = (
    _rule("markdown", "`~", r"^ {0,3}(```|~~~)[^\n]*\n(.*?)(?:^ {0,3}\1[ \t]*$|\Z)", _code, M | S),
    _rule("latex", "\\", r"\\begin\{(verbatim|lstlisting|minted)\}[^\n]*\n(.*?)(?:\\end\{\1\}|\Z)", _code, S),
    _rule("wiki", "<", r"<(nowiki|syntaxhighlight|source)\b[^>]*>(.*?)(?:</\1>|\Z)", _code, S),
    _rule("latex", "$\\", r"\$\$([^$]+)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|\\begin\{(?:equation|align|math|displaymath)\*?\}(.+?)\\end\{[a-z]+\*?\}", _formula, S),
    _rule("html", "<", r"<math[^>]*>(.+?)</math>", _formula, S),
    _rule("latex", "$", r"(?<![\w$\\])\$(?=[^\s$][^$\n]*\$)([^$\n]*[\\_^{}][^$\n]*)(?<=\S)\$(?![\d$])", _formula),
)
_SPECIAL = "|".join(SPECIAL.split())
_TAGS = rf"</?(?:{_NAMES})(?:\s[^<>]*)?/?>|<!doctype\b[^>]*>?|<!--.*?(?:-->|\Z)"
# Stand for the marks of headings and items made from other markup, so that those are not met again.
HASH, DASH = "\x04", "\x05"
RULES = (
    _rule("html", "<", r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "", S | I),
    _rule("html", "<", r"<br\s*/?>|</(?:p|div|tr|h[1-6])>", "\n", I),
    _rule("html", "<", r"<h([1-6])(?:\s[^<>]*)?>", lambda m: "\n" + HASH * int(m.group(1)) + " ", I),
    _rule("html", "<", r"<li(?:\s[^<>]*)?>", f"\n{DASH} ", I),
    _rule("html", "<", _TAGS, "", S | I),
    _rule("html", "&", r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});", lambda m: html.unescape(m.group()).replace("\xa0", " ")),
    _rule("wiki", "=", r"^(={1,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", lambda m: HASH * len(m.group(1)) + " " + m.group(2), M),
    _rule("wiki", "[", r"\[\[(?:[^\[\]\n]*\|)?([^\[\]\n|]+)\]\]", r"\1"),
    _rule("wiki", "{", r"\{\{(?:[^{}\n]*\|)?([^{}\n|]*)\}\}", r"\1"),
    _rule("latex", "`", r"``([^`'\n]+)''", "“\\1”"),
    _rule("wiki", "'", r"(?<!')'{2,5}(?!')([^'\n]+)(?<!')'{2,5}(?!')", r"\1"),
    _rule("", "|", r"^\{\||^\|\}|^\|-.*$", "", M, after="wiki"),
    _rule("", "%", r"(?<!\\)%.*$", "", M, after="\\begin{document}"),
    _rule("latex", "\\", r"\\((?:sub)*)section\*?\{([^{}]*)\}|\\(?:chapter|title)\{([^{}]*)\}", lambda m: HASH * (1 + (m.group(1) or "").count("sub")) + " " + (m.group(2) or m.group(3) or "")),
    _rule("latex", "\\", r"~?\\(?:cite|ref|label|eqref|pageref)[a-z]*\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", ""),
    _rule("latex", "\\", r"\\item\b(?:\[([^\]\n]*)\])?[ \t]*", lambda m: DASH + " " + (m.group(1) + " " if m.group(1) else "")),
    _rule("latex", "\\", r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?", ""),
    _rule("latex", "\\", r"\\(?:maketitle|par|noindent|newline)\b[ \t]*", ""),
    _rule("latex", "\\", r"\\footnote\{([^{}]*)\}", r" (\1)"),
    _rule("latex", "\\", r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1"),
    _rule("latex", "\\", r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", whole=True),
    _rule("latex", "\\", r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{", ""),
    _rule("", "~", r"(?<=\S)~(?=\S)", " ", after="latex"),
    _rule("markdown", "=-", r"^([^\s].*)\n(={2,}|-{2,})[ \t]*$", lambda m: ("# " if m.group(2)[0] == "=" else "## ") + m.group(1), M),
    _rule("markdown", ">", r"^ {0,3}>[ \t]*(?=\S)", "", M),
    _rule("markdown", "-*+", r"^( {0,3})[-*+][ \t]+(?=\S)", r"\1- ", M),
    _rule("", "*+", r"^( *)[*+][ \t]+(?=\S)", r"\1- ", M, after="markdown"),
    _rule("", "|", r"^[ \t]*\|[ \t:|-]+\|[ \t]*$\n?", "", M),
    _rule("markdown", "|", r"^[ \t]*\|(.*)\|[ \t]*$", lambda m: " | ".join(c.strip() for c in m.group(1).split("|")), M),
    _rule("markdown", "[", r"!?\[([^\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)", r"\1"),
    _rule("markdown", "`", r"(?<![`\w])`([^`\n]+)`(?![`'])", r"\1"),
    _rule("markdown", "~", r"~~([^\s~](?:[^~\n]*[^\s~])?)~~", r"\1"),
    _rule("markdown", "*", r"(?<![\w*])\*{1,3}([^\s*](?:[^*\n]*[^\s*])?)\*{1,3}(?![\w*])", r"\1"),
    _rule("markdown", "_", rf"(?<![\w_])__(?!(?:{_SPECIAL})__)([^\s_](?:[^_\n]*[^\s_])?)__(?![\w_])", r"\1"),
    _rule("markdown", "_", r"(?<![\w_])_(?![_\s])([^_\n]*[^_\s])_(?![\w_])", r"\1"),
    _rule("markdown", "#", r"^ {0,3}(#{1,6})[ \t]+(?=\S)", r"\1 ", M),
    _rule("markdown", ".)", r"^ {0,3}(\d{1,3}[.)])[ \t]+\S.*\n {0,3}\1[ \t]+\S", _same, M),
)
ORDER = ("html", "markdown", "wiki", "latex")


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style head template noscript".split())
RAW = frozenset("script style template noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody thead tfoot tr ul".split())
# Levels of nesting, as in browsers; deeper elements stand beside each other on the last one.
DEPTH = 512
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'<>])*)>|[^<]+|<", re.S)
_LOOK = re.compile(r"(?<![\w-])(id|class)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("tag", "look", "kids", "path")

    def __init__(self, tag: str, look: str, path: str) -> None:
        self.tag, self.look, self.path = tag, look, path
        self.kids: list[Node | str] = []

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)


def tree(text: str) -> Node:
    """A page's elements. Unclosed items and paragraphs are closed by the next; unknown ends are passed over."""
    if sys.getrecursionlimit() < 4 * DEPTH:
        sys.setrecursionlimit(4 * DEPTH)
    root = Node("", "", "")
    open_ = [root]
    at, raw = 0, None
    while at < len(text):
        m = raw.search(text, at) if raw else _TOKEN.match(text, at)
        if raw:
            at, raw = (m.start() if m else len(text)), None
            continue
        at = m.end()
        name = m.group(2)
        if name is None:
            data = m.group()
            if not data.startswith(("<!", "<?")):
                open_[-1].kids.append(html.unescape(data) if "&" in data else data)
            continue
        tag = name.lower()
        if m.group(1):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
            continue
        if tag == "li" or tag in BLOCK and open_[-1].tag == "p":
            while len(open_) > 1 and open_[-1].tag == ("li" if tag == "li" else "p"):
                open_.pop()
        look = tag
        if m.group(3):
            found = {k.lower(): a or b or c for k, a, b, c in _LOOK.findall(m.group(3))}
            look += "".join(f".{found[k]}" for k in ("id", "class") if found.get(k))
        node = Node(tag, look, f"{open_[-1].path}/{look}")
        open_[-1].kids.append(node)
        if tag not in VOID and len(open_) < DEPTH and not m.group(3).rstrip().endswith("/"):
            open_.append(node)
            if tag in RAW:
                raw = re.compile(rf"</{tag}\s*>", re.I)
    return root


_PAGE = re.compile(r"\s*(?:<!--.*?-->\s*|<\?.*?>\s*|<(script|style)\b.*?</\1\s*>\s*)*<(?:!doctype\s+html|html[\s>]|head[\s>]|body[\s>])", re.S | re.I)


def is_page(text: str) -> bool:
    """Whether a text is a whole HTML page: its first element, after comments and scripts, is one of a page."""
    return "<" in text and bool(_PAGE.match(text))


def contents(root: Node) -> list[tuple[str, str, int, str, list[str]]]:
    """(path, parent, depth, make-up, texts) of a page's block and styled elements; those at one path are one
    node of the merged tree. The make-up is the row of such elements inside it; texts are what it says
    itself, with numbers levelled."""
    out: dict[str, tuple[str, int, list[str], list[str]]] = {}

    def walk(node: Node, at: str, depth: int) -> None:
        for k in node.kids:
            if isinstance(k, str):
                if at and (said := " ".join(re.sub(r"\d+", "0", k).split())):
                    out[at][3].append(said)
            elif k.tag in SKIP:
                continue
            elif k.tag in BLOCK or k.look != k.tag:
                if k.path not in out:
                    out[k.path] = (at, depth + 1, [], [])
                if at:
                    out[at][2].append(k.look)
                walk(k, k.path, out[k.path][1])
            else:
                walk(k, at, depth)

    walk(root, "", 0)
    return [(path, parent, depth, "|".join(inner), said) for path, (parent, depth, inner, said) in out.items()]


def render(root: Node, dull: frozenset[str] = frozenset()) -> str:
    """Plain text of a tree without the elements at the paths in ``dull``."""
    out: list[str] = []

    def walk(node: Node, pre: bool) -> None:
        for k in node.kids:
            if isinstance(k, str):
                out.append(k if pre else re.sub(r"[ \t\r\f\v]*\n[ \t\r\f\v]*|[ \t\r\f\v\xa0]+", lambda m: "\n" if "\n" in m.group() else " ", k))
                continue
            if k.tag in SKIP or k.path in dull:
                continue
            if k.tag == "br":
                out.append("\n")
            elif k.tag == "img":
                continue
            elif re.fullmatch(r"h[1-6]", k.tag):
                out.append("\n" + "#" * int(k.tag[1]) + " ")
                walk(k, False)
                out.append("\n")
            elif k.tag == "pre":
                out.append("\n```\n")
                walk(k, True)
                out.append("\n```\n")
            elif k.tag == "math":
                out.append("$" + " ".join(k.text().split()) + "$")
            elif k.tag == "ref":
                continue
            elif k.tag == "li":
                out.append("\n- ")
                walk(k, pre)
                out.append("\n")
            elif k.tag in ("td", "th"):
                walk(k, pre)
                out.append(" | ")
            elif k.tag in BLOCK:
                out.append("\n")
                walk(k, pre)
                out.append("\n")
            else:
                walk(k, pre)

    walk(root, False)
    return "".join(out)


_OWN = dict.fromkeys(map(ord, "\x02\x03" + HASH + DASH))


def convert(text: str) -> tuple[str, set[str]]:
    """A text that is no page, converted, and the kinds of constructs met."""
    kept: list[str] = []
    met: set[str] = set()

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x02{len(kept) - 1}\x03"

    text = text.translate(_OWN)
    if "://" in text or ":\\" in text:
        text = _URL.sub(lambda m: m.group() if re.search(r"[<)&]", m.group()) else keep(m.group()), text)
    for r in KEPT:
        if any(c in text for c in r.needs):
            text, n = r.pattern.subn(lambda m, r=r: keep(r.make(m)), text)
            if n:
                met.add(r.kind)
    whole = text
    for r in RULES:
        if r.after and r.after not in met and r.after not in whole or not any(c in text for c in r.needs):
            continue
        while True:
            text, n = r.pattern.subn(r.make, text)
            if n and r.kind:
                met.add(r.kind)
            if not (n and r.whole):
                break
    back = lambda m: kept[int(m.group(1))]
    while "\x02" in text:
        text = re.sub(r"\x02(\d+)\x03", back, text)
    return text.replace(HASH, "#").replace(DASH, "-"), met


def clean(text: str | None, dull: frozenset[str] = frozenset()) -> tuple[str | None, list[str]]:
    """A text without markup and the kinds found; null stays null and a text without markup stays as it is."""
    if text is None or not text.strip():
        return text, []
    if is_page(text):
        made, met = render(tree(text), dull), {"html"}
    else:
        made, met = convert(text)
        if not met:
            return text, []
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", made, flags=re.M)).strip(), [k for k in ORDER if k in met]


def style_tree(pages: DataFrame, least_pages: int = 5, threshold: float = 0.2, decay: float = 0.9) -> DataFrame:
    """(id, dull array<string>): the element paths to be removed from each page of ``pages(id, host, content)``.

    The pages of a host are merged by element path. An element's own importance is the greater of the
    entropy of its make-up over its pages, to the base of their number, and of how few pages share what it
    says: one minus the mean, over its texts, of log(pages with the text) / log(pages). With ``l`` kinds of
    make-up, an element that holds others has the importance (1 - decay^l) of its own plus decay^l times
    the mean of those it holds, by the pages that have them. Elements on fewer than ``least_pages`` pages
    say nothing about the site and count as important. A branch is dull where it and all in it are under
    ``threshold``; only the roots of dull branches are given. Pages without any give no row.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i, h, c in zip(rows.id, rows.host, rows.content, strict=True):
                if is_page(c):
                    out += [(i, h, path, parent, depth, hash_text(inner), sorted({hash_text(t) for t in said})) for path, parent, depth, inner, said in contents(tree(c))]
            yield pd.DataFrame(out, columns=["id", "host", "path", "parent", "depth", "makeup", "said"])

    at = ["host", "path"]
    seen = materialize(pages.select("id", "host", "content").mapInPandas(parse, "id string, host string, path string, parent string, depth int, makeup long, said array<long>"), "elements")
    looks = seen.groupBy(*at, "makeup").agg(F.count(F.lit(1)).alias("c"), F.min("parent").alias("parent"), F.min("depth").alias("depth"))
    looks = looks.groupBy(*at).agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.min("parent").alias("parent"), F.min("depth").alias("depth"))
    texts = seen.select(*at, F.explode("said").alias("said")).groupBy(*at, "said").agg(F.count(F.lit(1)).alias("c"))
    texts = texts.groupBy(*at).agg(F.sum(F.log("c")).alias("logs"), F.count(F.lit(1)).alias("t"))
    base = F.log("m")
    makeup = F.coalesce(F.try_divide(base - F.col("clogc") / F.col("m"), base), F.lit(1.0))
    spoken = F.lit(1.0) - F.try_divide(F.col("logs"), F.col("t") * base)
    nodes = looks.join(texts, at, "left").withColumn("own", F.when(F.col("m") < least_pages, 1.0).otherwise(F.greatest(F.when(F.col("l") > 0, makeup), F.coalesce(spoken, F.lit(0.0)))))
    nodes = materialize(nodes.select(*at, "parent", "depth", "m", "l", "own"), "nodes")

    # From the deepest elements up; each level is as small as the merged tree.
    below, levels = None, []
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, 0, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("importance", F.col("own")).withColumn("most", F.col("own"))
        else:
            held = below.groupBy("host", F.col("parent").alias("path")).agg((F.sum(F.col("m") * F.col("importance")) / F.sum("m")).alias("_in"), F.max("most").alias("_most"))
            fade = F.pow(F.lit(decay), F.col("l"))
            joined = level.join(held, at, "left").withColumn("importance", F.when(F.col("_in").isNull() | (F.col("m") < least_pages), F.col("own")).otherwise((1 - fade) * F.col("own") + fade * F.col("_in")))
            level = joined.withColumn("most", F.greatest("importance", F.coalesce("_most", F.lit(0.0)))).drop("_in", "_most")
        below = materialize(level, "level")
        levels.append(below.where((F.col("m") >= least_pages) & (F.col("most") < threshold)))
    if not levels:
        return seen.select("id", F.array().cast("array<string>").alias("dull")).limit(0)
    dull = reduce(DataFrame.unionByName, levels).select(*at, "parent", "m")
    roots = materialize(dull.join(dull.select("host", F.col("path").alias("parent")), ["host", "parent"], "left_anti").select(*at, "m"), "dull")
    return skew_join(seen.select("id", *at), roots, at, size="m").groupBy("id").agg(F.collect_list("path").alias("dull"))


def hash_text(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - 2**63


def cleaned(documents: DataFrame) -> DataFrame:
    """(id, field, kinds array<string>, text): title and content of every document without markup.

    ``documents(id, url, title, content, ingested_at)``; of repeated rows of an id the last to arrive
    counts. A null value gives a row with a null text, a blank one stays as it is. Kinds are html,
    markdown, wiki and latex, of the constructs met in the conversion. Documents without an absolute URL
    belong to no host and are not cleared by a style tree. An empty table gives no rows.
    """
    rows = documents.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("ingested_at", "url", "title", "content")).alias("d"))
    rows = rows.select("id", "d.title", "d.content", F.nullif(F.lower(F.regexp_extract("d.url", r"(?i)^https?://([^/?#]+)", 1)), F.lit("")).alias("host"))
    rows = materialize(rows, "documents")
    pages = rows.where(F.col("host").isNotNull() & F.col("content").rlike(r"(?i)<(?:!doctype|html|head|body)[\s>]"))
    joined = rows.join(style_tree(pages), "id", "left")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for i, title, content, paths in zip(b.id, b.title, b.content, b.dull, strict=True):
                for field, value in (("title", title), ("content", content)):
                    text, kinds = clean(value if isinstance(value, str) else None, frozenset(paths) if field == "content" and paths is not None else frozenset())
                    out.append((i, field, kinds, text))
            yield pd.DataFrame(out, columns=["id", "field", "kinds", "text"])

    return joined.select("id", "title", "content", "dull").mapInPandas(work, "id string, field string, kinds array<string>, text string")
