"""Highlight ranges and snippets of result texts (offsets in characters)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.stem import stem_word
from lexloom.functions.text import fold_text

_WORD = re.compile(r"[^\W_]+")


def ranges(text: str, terms: list[dict]) -> list[tuple[int, int]]:
    """Words of the text that a matched term covers: equal folded or stemmed, or begun by a prefix."""
    if not terms:
        return []
    exact = {t["term"] for t in terms}
    starts = tuple(t["source"] for t in terms if t["kind"] == "prefix" and t["source"])
    out = []
    for m in _WORD.finditer(text):
        word = fold_text(m.group())
        if len(word) > 1 and (word in exact or stem_word(word) in exact or (starts and word.startswith(starts))):
            out.append(m.span())
    return out


def excerpt(text: str, terms: list[dict], radius: int = 80, most: int = 8) -> tuple[str, list[tuple[int, int]]]:
    """Text around the first hit, cut at blanks where there are any, and the hits within it."""
    radius = max(10, radius)
    hits = ranges(text, terms)
    anchor = hits[0][0] if hits else 0
    a, b = max(0, anchor - radius), min(len(text), anchor + radius)
    if a and a <= (blank := text.find(" ", a)) < anchor:
        a = blank + 1
    if b < len(text) and (blank := text.rfind(" ", 0, b + 1)) > anchor:
        b = blank
    lead = "…" if a else ""
    shift = len(lead) - a
    inside = [(max(s, a) + shift, min(e, b) + shift) for s, e in hits if e > a and s < b]
    return lead + text[a:b] + ("…" if b < len(text) else ""), inside[: max(0, most)]


def highlight_ranges(text: Column, terms: Column) -> Column:
    """ARRAY<STRUCT<start,end>>; null texts and no terms give an empty list."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in ranges(t or "", list(f) if f is not None else [])] for t, f in zip(texts, found, strict=True)])

    return run(text, F.transform(terms, lambda t: F.struct(t["term"].alias("term"), t["source"].alias("source"), t["kind"].alias("kind"))))


def snippet(text: Column, terms: Column, radius: int = 80, most: int = 8) -> Column:
    """STRUCT<text, ranges>; a null text gives an empty snippet."""

    @F.pandas_udf("struct<text:string,ranges:array<struct<start:int,end:int>>>")
    def run(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        got = [excerpt(t or "", list(f) if f is not None else [], radius, most) for t, f in zip(texts, found, strict=True)]
        return pd.DataFrame({"text": [g[0] for g in got], "ranges": [[{"start": s, "end": e} for s, e in g[1]] for g in got]})

    return run(text, F.transform(terms, lambda t: F.struct(t["term"].alias("term"), t["source"].alias("source"), t["kind"].alias("kind"))))
