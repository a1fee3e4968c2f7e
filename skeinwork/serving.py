"""What a service would answer, as functions that return DataFrames or plain values: search, one paper, trends, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.fulltext import field_facet
from .operators.pipeline import search


class Service:
    """Over documents (doc_id, text, lang, source); vectors (doc_id, vector) are those of embed_column, if there are any stored."""

    def __init__(self, docs: DataFrame, vectors: DataFrame | None = None, key: str = "doc_id"):
        self.docs, self.vectors, self.key = docs, vectors, key

    def search(self, text: str, k: int = 10) -> DataFrame:
        return search(self.docs, self.vectors, text, k, self.key)

    def paper(self, key: int | str) -> dict | None:
        """One document, or None."""
        found = self.docs.filter(F.col(self.key) == key).limit(1).collect()
        return found[0].asDict(True) if found else None

    def preview(self, key: int | str, size: int = 300) -> dict | None:
        """Title and beginning of one document."""
        title = F.substring_index("text", "\n", 1)
        found = self.docs.filter(F.col(self.key) == key).select(self.key, title.alias("title"), F.substring("text", 1, size).alias("preview")).limit(1).collect()
        return found[0].asDict(True) if found else None

    def trends(self, period: str = "lang", limit: int = 10) -> DataFrame:
        """(value, n, share): how often each value of a column stands, most first."""
        total = self.docs.agg(F.count(F.lit(1)).alias("_all"))  # one row
        return field_facet(self.docs, F.col(period), limit).crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share")).orderBy(F.desc("n"), "value")

    def stats(self) -> DataFrame:
        """One row: documents, characters, languages, sources."""
        return self.docs.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"))
