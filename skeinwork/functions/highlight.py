"""Snippets around the first match with matches marked, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_html


def fragment(text: Column, terms: list[str], centred: bool, size: int, tag: str = "em") -> Column:
    """A fragment of ``size`` characters about the first match, escaped, with matches tagged.

    centred: the window begins half its size before the match, and a text without a match gives its escaped head.
    Otherwise terms have two letters or more, the window moves back at the text's end, and a head that is cut ends in dots.
    """
    terms = [t.strip() for t in terms if len(t.strip()) >= (1 if centred else 2)]
    head = escape_html(F.substring(text, 1, size))
    if not centred:
        head = F.concat(head, F.when(F.length(text) > size, "...").otherwise(""))
    if not terms:
        return F.coalesce(head, F.lit(""))
    either = "|".join(re.sub(r"(\W)", r"\\\1", t) for t in terms)
    at = F.regexp_instr(text, F.lit(f"(?i)({either})"))  # 1-based, 0 if there is none
    start = F.greatest(F.lit(0), at - 1 - size // 2)
    end = F.least(F.length(text), start + size)
    if not centred:
        start = F.when((end - start < size) & (start > 0), F.greatest(F.lit(0), end - size)).otherwise(start)
    body = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    before, after = F.when(start > 0, "...").otherwise(""), F.when(end < F.length(text), "...").otherwise("")
    marked = F.regexp_replace(escape_html(body), f"(?i)({either})", f"<{tag}>$1</{tag}>")
    return F.coalesce(F.when(at > 0, F.concat(before, marked, after)).otherwise(head), F.lit(""))
