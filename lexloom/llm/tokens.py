"""Token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the characters of Unicode property White_Space, which that pattern's \s means.
_WHITE = " \t\n\r\f\v\x85\xa0  -     　"
_SEGMENT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_WHITE_ENDS = re.compile(f"^[{_WHITE}]|[{_WHITE}]$|^$")
# Entries a cache holds before it is emptied, and the length from which a run is not kept.
CACHED, KEPT = 400_000, 200


class TokenCounter:
    """Counts tokens without keeping them.

    No token of the pattern spans from a visible character to white space after it, so a text's count is
    the sum over its runs of white space plus visible characters; those repeat, and each is encoded once.
    """

    _of: dict[str, TokenCounter] = {}

    def __init__(self, path: str, vocabulary: bytes | None = None) -> None:
        import tiktoken

        if vocabulary is None:
            with open(path, "rb") as f:
                vocabulary = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words: dict[str, int] = {}
        self.segments: dict[str, int] = {}

    @classmethod
    def at(cls, path: str, vocabulary: bytes | None = None) -> TokenCounter:
        if path not in cls._of:
            cls._of[path] = cls(path, vocabulary)
        return cls._of[path]

    def _slow(self, text: str) -> int:
        n, seen = 0, self.segments
        if len(seen) > CACHED:
            seen.clear()
        for s in _SEGMENT.findall(text):
            c = seen.get(s)
            if c is None:
                c = len(self.encode(s))
                if len(s) < KEPT:
                    seen[s] = c
            n += c
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ")
        try:
            n = sum(map(self.words.__getitem__, rest))
        except KeyError:
            if len(self.words) > CACHED:
                self.words.clear()
            n = 0
            for w in rest:
                c = self.words.get(w)
                if c is None:
                    if _WHITE_ENDS.search(w):
                        return self._slow(text)  # the blank belongs to a longer run of white space
                    c = len(self.encode(" " + w))
                    if len(w) < KEPT:
                        self.words[w] = c
                n += c
        return self._slow(text) if rest and _WHITE_ENDS.search(first) else n + (self._slow(first) if first else 0)


def token_count(text: Column | str, path: str = TOKENIZER) -> Column:
    """Tokens of each text; 0 for null and empty texts. The vocabulary (some megabytes) is read where the job is
    started and broadcast, so executors need no copy of the file."""
    with open(path, "rb") as f:
        shared = SparkSession.active().sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counter = TokenCounter._of.get(path) or TokenCounter.at(path, shared.value)
        return pd.Series([counter.count(t) for t in texts], dtype="int64")

    return count(text)
