"""Faceted filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def faceted_filter(df: DataFrame, year: str | None = None, category: str | None = None, tag: str | None = None, domain: str | None = None) -> DataFrame:
    """Rows of (year, category, tags, domain) that meet every given criterion, letter case and outer blanks aside.

    A year that no row has is ignored; an unknown category, tag or domain leaves nothing. No criteria keep all rows.
    """
    if year and df.filter(F.col("year") == year).limit(1).collect():
        df = df.filter(F.col("year") == year)
    if category:
        df = df.filter(F.lower("category") == category.strip().lower())
    if tag:
        df = df.filter(F.exists("tags", lambda t: F.lower(t) == tag.strip().lower()))
    if domain:
        df = df.filter(F.lower("domain") == domain.strip().lower())
    return df
