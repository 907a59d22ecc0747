"""Light English stems, stated once as steps of rules and read both by Spark and by Python."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Applies to words that match ``pattern`` (at their end): the match goes, or the last ``cut`` letters
    where that is given, and ``add`` comes in its place. The word needs ``least`` letters, ``left`` of them
    before what goes, and a vowel before its last ``vowel`` letters where that is given. ``then`` is a step
    for the result. The first rule of a step that applies ends the step."""

    pattern: str
    cut: int | None = None
    add: str = ""
    least: int = 0
    left: int = 0
    vowel: int | None = None
    then: tuple[Rule, ...] = ()

    def after(self, word: Column) -> Column:
        return _column_step(word, self.then)

    @property
    def plain(self) -> bool:
        return self.pattern.isalpha()


VOWEL = "[aeiouy]"

# Derivational endings in the order they are tried and what each becomes, and the endings
# dropped last, of which only the longest that fits is looked at.
DERIVED = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("biliti", "ble"),
    ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
DROPPED = ("ement", "ment", "able", "ible", "ance", "ence", "ate", "iti", "ion", "al", "er", "ic", "ous", "ive", "ize")

MENDED = (Rule("(?:at|bl|iz)$", 0, "e"), Rule("(?:ll|ss|zz)$", 0), Rule(r"([^aeiou])\1$", 1))
STEPS: tuple[tuple[Rule, ...], ...] = (
    (Rule("sses", 2), Rule("ies", 2), Rule("ss", 0), Rule("s", 1, vowel=2)),
    (Rule("eedly", 3, least=7), Rule("eed", 1, least=5), *(Rule(e, vowel=len(e), then=MENDED) for e in ("ingly", "edly", "ing", "ed"))),
    (Rule("[^aeiouy]y$", 1, "i", least=3),),
    tuple(Rule(e, add=to, left=2, least=len(e) + 2) for e, to in DERIVED),
    (Rule(f"(?:{'|'.join(DROPPED)})$", least=5, left=3),),
    (Rule("e", 1, least=5),),
)
SHORT = 3


def _let(value: Column, body) -> Column:
    """Binds a value to a lambda variable; written out, every use would repeat all that makes it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _column_step(word: Column, rules: tuple[Rule, ...]) -> Column:
    n = F.length(word)
    out = None
    for r in rules:
        goes = F.lit(r.cut) if r.cut is not None else F.lit(len(r.pattern)) if r.plain else F.length(F.regexp_extract(word, r.pattern, 0))
        fits = word.endswith(r.pattern) if r.plain else word.rlike(r.pattern)
        fits = fits & (n >= r.least) & (n - goes >= r.left)
        if r.vowel is not None:
            fits = fits & F.left(word, n - r.vowel).rlike(VOWEL)
        made = word if r.cut == 0 else F.left(word, n - goes)
        made = F.concat(made, F.lit(r.add)) if r.add else made
        if r.then:
            made = _let(made, r.after)
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out.otherwise(word)


def stem_english(word: Column) -> Column:
    """Stems of folded words, in built-in expressions. Up to three letters stay as they are; null stays null."""
    stem = reduce(lambda w, rules: _let(w, lambda x: _column_step(x, rules)), STEPS, word)
    return F.when(F.length(word) <= SHORT, word).otherwise(stem)


def _text_step(word: str, rules: tuple[Rule, ...]) -> str:
    for r in rules:
        m = re.search(f"{r.pattern}$" if r.plain else r.pattern, word)
        if not m:
            continue
        goes = len(m.group()) if r.cut is None else r.cut
        vowel = r.vowel is None or re.search(VOWEL, word[: max(0, len(word) - r.vowel)])
        if len(word) >= r.least and len(word) - goes >= r.left and vowel:
            return _text_step(word[: len(word) - goes] + r.add, r.then)
    return word


def stem_word(word: str) -> str:
    """``stem_english`` of one word, for highlighting on the Python side."""
    return word if len(word) <= SHORT else reduce(_text_step, STEPS, word)
