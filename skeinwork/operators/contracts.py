"""Output contracts of scraped items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def directives(docstring: str) -> dict[str, list[str]]:
    """@name arg arg lines of a docstring."""
    found = (line.strip()[1:].split() for line in docstring.splitlines() if line.strip().startswith("@"))
    return {w[0]: w[1:] for w in found if w}


def meets(required: list[str], filled: list[str] = ()) -> Column:
    """Whether a row has the required fields, those in filled not empty."""
    tests = [F.col(c).isNotNull() for c in required] + [F.length(c) > 0 for c in filled]
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def verify(items: DataFrame, required: list[str]) -> bool:
    """Every item has the required fields; no items with required fields is a failure."""
    if missing := [c for c in required if c not in items.columns]:
        return not missing
    counts = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(meets(required)).alias("ok")).first()
    return counts["n"] == counts["ok"] and (counts["n"] > 0 or not required)
