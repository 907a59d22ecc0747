"""Text analysis as Columns: cleaning, tokens, folding, stemming, query analysis, ids, route globs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.stem import stem_english

WORD = r"([\p{L}\p{N}]+)"
# Fixed value: white space, the no-break and other Unicode blanks included, inside a character class.
WHITE = r"\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def clean(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " "))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, as written. Null gives an empty list."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), 1), F.array().cast("array<string>"))


def tokenize(text: Column) -> Column:
    """Unfielded index terms: lower-cased runs of letters and digits longer than one character."""
    return F.filter(tokens(F.lower(text)), lambda t: F.length(t) > 1)


def fold_text(word: str) -> str:
    """Compatibility-decomposed, without marks, lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if unicodedata.category(c)[0] != "M").lower()


def fold(word: Column) -> Column:
    """``fold_text`` of a column; Spark folds plain ASCII, Python only what is left.

    The function counts as nondeterministic, which it is not, so that a filter on the result is neither moved
    below an aggregate nor makes the words go through Python a second time.
    """

    @F.pandas_udf("string")
    def rest(words: pd.Series) -> pd.Series:
        seen = {w: fold_text(w) for w in words.dropna().unique()}
        return pd.Series([seen.get(w) for w in words], dtype=object)

    plain = word.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, F.lower(word)).otherwise(rest.asNondeterministic()(F.when(~plain, word)))


@dataclass(frozen=True)
class Analyzer:
    """How words become terms. ``stemmer`` is none, ``en``, or the id of a registered stemmer."""

    folding: bool = True
    stemmer: str | None = None


_stemmers: dict[str, Callable[[Column], Column]] = {"en": stem_english}


def register_stemmer(name: str, stem: Callable[[Column], Column]) -> None:
    """A stemmer from Column to Column (built-in expressions or a pandas UDF) under a stable id."""
    _stemmers[name] = stem


def analyze_token(word: Column, analyzer: Analyzer = Analyzer()) -> Column:
    folded = fold(word) if analyzer.folding else F.lower(word)
    if analyzer.stemmer is None:
        return folded
    if analyzer.stemmer not in _stemmers:
        raise ValueError(f"no stemmer {analyzer.stemmer!r} is registered")
    return _stemmers[analyzer.stemmer](folded)


def opens_prefix(text: Column) -> Column:
    """Whether the last word of a query may still be growing: the text ends in a letter or digit."""
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]$"), F.lit(False))


def chunk_id(document_id: Column, heading: Column, offset: Column) -> Column:
    """First 16 hex digits of the SHA-256 of document, heading and word offset, parted by NUL."""
    parts = F.concat(document_id, F.lit("\0"), F.coalesce(heading, F.lit("")), F.lit("\0"), offset.cast("string"))
    return F.substring(F.sha2(parts, 256), 1, 16)


def xxh64(text: Column) -> Column:
    """The 64-bit xxHash (seed 0) of a text's UTF-8 bytes as 16 hex digits. Spark's own function has another
    seed, so the hash is made in Python, batch by batch; null stays null."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        import xxhash

        return pd.Series([None if t is None else xxhash.xxh64_hexdigest(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)

    return digest(text)


def embedding_text(title: Column, heading: Column, content: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(heading, F.lit("")), F.coalesce(content, F.lit("")))


def index_text(title: Column, heading: Column, content: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(heading, F.lit("")), F.coalesce(content, F.lit("")))


def glob_regex(glob: str) -> str:
    """A route glob as an anchored regular expression: ``**`` crosses slashes, ``*`` and ``?`` do not; ``{a,b}``."""
    out, k, braces = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("/**", k) and k + 3 == len(glob):
            out += "(?:/.*)?"
            k += 3
            continue
        if glob.startswith("**/", k):
            out += "(?:.*/)?"
            k += 3
            continue
        if glob.startswith("**", k):
            out += ".*"
            k += 2
            continue
        if c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        k += 1
    return f"^{out}$"


def route_matches(url: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a url fits one of ``include`` (all routes by default) and none of ``exclude``."""
    fits = lambda gs: reduce(lambda a, b: a | b, [url.rlike(glob_regex(g)) for g in gs], F.lit(False))
    return fits(include or ["/**"]) & ~fits(exclude or [])


def route_of_html(path: Column) -> Column:
    """The route of a rendered file: index files stand for their directory."""
    bare = F.regexp_replace(F.regexp_replace(path, r"/index\.html$", ""), r"\.html$", "")
    return F.when(path == "index.html", F.lit("/")).otherwise(F.concat(F.lit("/"), bare))


def provider_directory(provider: str) -> str:
    """A provider id as a file name: other bytes than letters, digits, ``-._`` as ``~hh``."""
    if not provider:
        raise ValueError("an embedding provider needs an id")
    raw = provider.encode()
    escape = lambda b: f"~{b:02x}"
    safe = "".join(chr(b) if re.match(rb"[A-Za-z0-9._-]", bytes([b])) else escape(b) for b in raw)
    return "".join(map(escape, raw)) if safe in (".", "..") else safe


# Byte units, decimal and binary.
UNITS = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "kib": 2**10, "mib": 2**20, "gib": 2**30}


def parse_bytes(size: str) -> int:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-z]*)\s*", size, re.I)
    unit = UNITS.get((m.group(2) or "b").lower()) if m else None
    if not m or not unit or (got := int(float(m.group(1)) * unit)) >= 2**53:
        raise ValueError(f"not a byte size: {size!r}")
    return got


def format_bytes(n: int) -> str:
    for unit, name in ((10**9, "GB"), (10**6, "MB"), (10**3, "kB")):
        if n >= unit:
            return f"{n / unit:.1f} {name}"
    return f"{n} B"


def safe_name(name: str) -> str:
    """A corpus name usable as a directory: no separators, not a relative step."""
    if not name or re.search(r"[/\\]", name) or name in (".", ".."):
        raise ValueError(f"not a corpus name: {name!r}")
    return name


def safe_key(key: str) -> str:
    """An artifact key under the index folder: relative, without steps up, query or fragment."""
    if re.match(r"[a-z][a-z0-9+.-]*:|/", key, re.I) or re.search(r"[?#\\]", key) or ".." in key.split("/"):
        raise ValueError(f"not an artifact key: {key!r}")
    return key
