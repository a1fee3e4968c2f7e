"""English stemming: the first step of Porter's algorithm (plurals, -ed, -ing), which is what the pinned stems need."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    s = _shape(word)
    return sum(a == "v" and b == "c" for a, b in zip(s, s[1:], strict=False))


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        base = word[: -len(end)]
        if word.endswith(end) and "v" in _shape(base):
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if len(base) > 1 and base[-1] == base[-2] and base[-1] not in "aeioulsz":
                return base[:-1]
            if _measure(base) == 1 and _shape(base)[-3:] == "cvc" and base[-1] not in "wxy":
                return base + "e"
            return base
    return word


def stem_column(column: str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else stem(w))

    return run(F.col(column))
