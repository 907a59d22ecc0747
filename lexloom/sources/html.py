"""HTML and Markdown parsing for the readers, on the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that are no content of a rendered page, and where its body is looked for.
NOISE = ("script", "style", "template", "noscript", "nav", "aside", "svg", "math", "[data-search-ignore]")
BODIES = ("[data-search-body]", "main", "article", "body")
TEXTS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "blockquote")


class Element:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.kids: list[Element | str] = []

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def each(self):
        for k in self.kids:
            if isinstance(k, Element):
                yield k
                yield from k.each()

    def first(self, selector: str) -> Element | None:
        return next((e for e in self.each() if fits(e, selector)), None)

    def without(self, selectors: tuple[str, ...]) -> Element:
        out = Element(self.tag, self.attrs)
        out.kids = [k if isinstance(k, str) else k.without(selectors) for k in self.kids if isinstance(k, str) or not any(fits(k, s) for s in selectors)]
        return out


def fits(e: Element, selector: str) -> bool:
    """Simple selectors: ``tag``, ``#id``, ``.class``, ``[attr]``, ``[attr=value]``, and these combined."""
    parts = re.findall(r"^[a-zA-Z][\w-]*|#[\w-]+|\.[\w-]+|\[[^\]]+\]", selector)
    for p in parts:
        if p[0] == "#":
            ok = e.attrs.get("id") == p[1:]
        elif p[0] == ".":
            ok = p[1:] in e.attrs.get("class", "").split()
        elif p[0] == "[":
            name, _, value = p[1:-1].partition("=")
            ok = name in e.attrs and (not value or e.attrs[name] == value.strip("'\""))
        else:
            ok = e.tag == p.lower()
        if not ok:
            return False
    return bool(parts)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("li", "p", "td", "th", "tr", "option") and self.open[-1].tag == tag:
            self.open.pop()
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(e)
        if tag not in VOID and len(self.open) < 200:
            self.open.append(e)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def parse(text: str) -> Element:
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def clean(text: str | None) -> str:
    return " ".join((text or "").split())


def charset_of(raw: bytes) -> str:
    """The declared encoding in the first 4 KiB, else UTF-8."""
    m = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", raw[:4096], re.I)
    name = m.group(1).decode("ascii") if m else "utf-8"
    try:
        b"".decode(name)
    except LookupError:
        return "utf-8"
    return name


def decode(raw: bytes) -> str:
    return raw.decode(charset_of(raw), errors="replace").removeprefix("﻿")


# Prefixes that a metadata name may have before its own name, names that stand for another, and
# markers that are no metadata.
PREFIXES = ("data-search-", "og:")
ALIASES = {"docusaurus_locale": "locale", "docusaurus_version": "version"}
MARKERS = ("body", "ignore")


def _own_name(name: str) -> str | None:
    low = name.lower()
    return ALIASES.get(low) or next((low.removeprefix(p) for p in PREFIXES if low.startswith(p)), None)


def _pairs(root: Element) -> Iterator[tuple[str, str | None]]:
    """Every (name, value) that a page states about itself, in the order in which the first counts."""
    for e in root.each():
        if e.tag == "meta":
            stated = e.attrs.get("name", e.attrs.get("property"))
            if stated:
                yield stated, e.attrs.get("content")
                yield _own_name(stated) or "", e.attrs.get("content")
            yield from ((key, raw) for attr, raw in e.attrs.items() if (key := _own_name(attr)) not in (None, *MARKERS))
    page = root.first("html")
    yield from ((key, page.attrs.get("lang")) for key in ("lang", "locale") if page)


def metadata_of(root: Element) -> dict[str, str]:
    """Of all meta elements, by name and by normalised name, and the page's language; the first value of a name
    stays, and blank ones do not count."""
    known = [(k, v) for k, raw in _pairs(root) if k and (v := clean(raw))]
    return dict(reversed(known))


# Where a page's title is looked for, the first that is there deciding: a selector, and the attribute that holds it.
TITLES = (("meta[name=data-search-title]", "content"), ("meta[data-search-title]", "data-search-title"), ("meta[property=og:title]", "content"), ("title", None))


def title_of(root: Element, heading: str, route: str) -> str:
    there = ((e, attr) for selector, attr in TITLES if (e := root.first(selector)) and (attr is None or attr in e.attrs))
    e, attr = next(there, (None, None))
    stated = "" if e is None else e.text() if attr is None else e.attrs[attr]
    return clean(stated) or heading or route


def sections(body: Element) -> list[tuple[str | None, str]]:
    """(heading, text) of a body; headings open sections, and those without text are left out. Elements
    inside others are taken once, with the outermost; a body without any such element is one section."""
    out: list[tuple[str | None, str]] = []
    heading: str | None = None
    texts: list[str] = []

    def flush() -> None:
        if text := clean(" ".join(texts)):
            out.append((heading, text))
        texts.clear()

    def walk(e: Element) -> None:
        nonlocal heading
        for k in e.kids:
            if isinstance(k, str):
                continue
            if k.tag in TEXTS:
                text = clean(k.text())
                if text and re.fullmatch("h[1-6]", k.tag):
                    flush()
                    heading = text
                elif text:
                    texts.append(text)
            else:
                walk(k)

    walk(body)
    flush()
    return out or ([(None, clean(body.text()))] if clean(body.text()) else [])


def page(text: str, route: str, bodies: tuple[str, ...] = BODIES, exclude: tuple[str, ...] = ()) -> dict:
    """A rendered page as title, metadata and sections of its body."""
    root = parse(text)
    body = next((b for s in bodies if (b := root.first(s)) is not None), None) or root.first("body") or root
    body = body.without((*NOISE, *exclude))
    h1 = body.first("h1") or root.first("h1")
    got = sections(body)
    return {"title": title_of(root, clean(h1.text()) if h1 else "", route), "metadata": metadata_of(root), "headings": [h for h, _ in got], "sections": [s for _, s in got]}


_FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """``key: value`` pairs between two ``---`` lines at the top, and the rest. A list, in brackets or as items
    below its key, becomes its elements joined by commas; a key of a nested mapping has its parents' before it,
    parted by dots; comments and quotes are left out."""
    m = _FRONT.match(text)
    if not m:
        return {}, text
    out: dict[str, list[str]] = {}
    above: list[tuple[int, str]] = []  # indents and keys of the mappings around a line
    bare = lambda v: re.sub(r"\s+#.*$", "", v).strip().strip("'\"") if not re.match(r"\s*['\"]", v) else v.strip()[1:].rsplit(v.strip()[0], 1)[0]
    for ln in m.group(1).splitlines():
        indent, line = len(ln) - len(ln.lstrip()), ln.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("- ") and above:
            out.setdefault(".".join(k for _, k in above), []).append(bare(line[2:]))
            continue
        key, colon, value = line.partition(":")
        if not colon:
            continue
        above = [(n, k) for n, k in above if n < indent] + [(indent, key.strip().strip("'\""))]
        name, value = ".".join(k for _, k in above), value.strip()
        if value.startswith("[") and value.endswith("]"):
            out[name] = [bare(v) for v in value[1:-1].split(",")]
        elif value:
            out[name] = [bare(value)]
    return {k: ",".join(x for x in v if x) for k, v in out.items() if any(v)}, text[m.end() :]
