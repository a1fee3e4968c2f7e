"""A stored inverted index: postings written once by term, read by the terms of a query only, kept up by adds and deletes.

``postings`` holds (field, term, key, tf, positions, len) in folders by segment and by bucket of the term's hash, sorted by
term, so a query's scan is pruned to its buckets' files and in them to its terms' row groups. Adding documents writes a
segment; deleting ids writes the ids with the last segment that the deletion covers, so a document added again later is
live. ``merge`` rewrites what is live as one segment. The length of the field lies in the posting, so scoring joins nothing
but the one row of statistics and the query's own terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fulltext as X

BUCKETS = 64


def postings(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(field, term, key, tf, positions, len) of the text columns in ``fields`` (field name to column)."""
    parts = None
    for name, column in fields.items():
        tokened = X.once(df.select(key, F.coalesce(F.col(column), F.lit("")).alias("_s")), "_t", X.tokens(F.col("_s")))
        each = tokened.select(F.lit(name).alias("field"), key, F.size("_t").alias("len"), F.posexplode("_t").alias("pos", "term"))
        parts = each if parts is None else parts.unionByName(each)
    grouped = parts.groupBy("field", "term", key).agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.first("len").alias("len"))
    return grouped.select("field", "term", F.col(key).alias("key"), "tf", "positions", "len")


def _follows(places: str, slop: int) -> Callable[[Column], Column]:
    return lambda q: F.exists(places, lambda p: (q > p) & (q - p <= 1 + slop))


def bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """The index of one table's text columns, in a folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str, key: str, fields: dict[str, str]):
        self.spark, self.root, self.key, self.fields = spark, root.rstrip("/"), key, fields
        self.segments, self.deleted = 0, False

    @classmethod
    def build(cls, df: DataFrame, root: str, key: str, fields: dict[str, str]) -> SearchIndex:
        made = cls(df.sparkSession, root, key, fields)
        made._write(df)
        return made

    def _write(self, df: DataFrame) -> None:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = postings(df, self.key, self.fields).withColumn("bucket", bucket("term"))
        # by range, not by bucket: a term that many documents hold is split over several tasks
        dealt = rows.repartitionByRange(parts, "bucket", "term", "key").sortWithinPartitions("bucket", "term", "key")
        dealt.write.partitionBy("bucket").mode("append").parquet(f"{self.root}/postings/segment={self.segments}")
        lens = [F.size(X.tokens(F.coalesce(F.col(c), F.lit("")))).alias(f"len_{n}") for n, c in self.fields.items()]
        df.select(F.col(self.key).alias("key"), *lens).write.parquet(f"{self.root}/docs/segment={self.segments}")
        self.segments += 1

    def add(self, df: DataFrame) -> None:
        """Index documents; those whose ids are there already take their place."""
        self.delete(df.select(self.key))
        self._write(df)

    def delete(self, ids: DataFrame) -> None:
        """Ids (first column) vanish from hits, counts and statistics."""
        ids.select(F.col(ids.columns[0]).alias("gone"), F.lit(self.segments - 1).alias("upto")).write.mode("append").parquet(f"{self.root}/deletes")
        self.deleted = True

    def _live(self, part: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{part}")
        if not self.deleted:
            return rows
        gone = self.spark.read.parquet(f"{self.root}/deletes").groupBy("gone").agg(F.max("upto").alias("upto"))
        return rows.join(gone, (F.col("key") == F.col("gone")) & (F.col("segment") <= F.col("upto")), "left_anti")

    def read(self, terms: list[str]) -> DataFrame:
        """Live postings of some terms: the scan is pruned to their buckets."""
        buckets = sorted({r["b"] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket("t").alias("b")).collect()})
        return self._live("postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def stats(self) -> DataFrame:
        """One row: live documents and the sum of each field's length."""
        return self._live("docs").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"len_{f}").alias(f"sum_{f}") for f in self.fields])

    def search(self, terms: dict[str, float], boosts: dict[str, float] | None = None) -> DataFrame:
        """(key, score): BM25 of the live documents that hold a term; terms and fields with their boosts."""
        boosts = boosts or dict.fromkeys(self.fields, 1.0)
        hits = self.read(list(terms)).filter(F.col("field").isin(list(boosts)))
        df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        weight = F.lit(0.0)
        for t, b in terms.items():
            weight = F.when(F.col("term") == t, float(b)).otherwise(weight)
        boost, total = F.lit(0.0), F.lit(0)
        for f, b in boosts.items():
            boost, total = F.when(F.col("field") == f, float(b)).otherwise(boost), F.when(F.col("field") == f, F.col(f"sum_{f}")).otherwise(total)
        # a row for each of the query's terms and fields, and one of statistics
        each = hits.join(F.broadcast(df), ["field", "term"]).crossJoin(F.broadcast(self.stats()))
        part = boost * weight * X.idf(F.col("n"), F.col("df")) * X.bm25_part(F.col("tf"), F.col("len"), total / F.col("n"))
        return each.groupBy("key").agg(F.sum(part).alias("score")).select(F.col("key").alias(self.key), "score")

    def phrase(self, words: list[str], slop: int = 0, field: str | None = None) -> DataFrame:
        """(key) of the live documents in which the words follow one another, each at most 1 + slop places after the one before."""
        field = field or next(iter(self.fields))
        hits = self.read(words).filter(F.col("field") == field)
        held = hits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")).filter(F.size("at") == len(set(words)))
        found = X.once(held, "_p0", F.col("at")[words[0]])
        for k, w in enumerate(words[1:], 1):
            found = X.once(found, f"_p{k}", F.filter(F.col("at")[w], _follows(f"_p{k - 1}", slop)))
        return found.filter(F.size(f"_p{len(words) - 1}") > 0).select(F.col("key").alias(self.key))

    def status(self) -> dict[str, int]:
        """Documents, live documents, segments, and distinct terms of live documents."""
        whole = self.spark.read.parquet(f"{self.root}/docs").count()
        live = self._live("docs").count()
        return {"docs": whole, "live": live, "deleted": whole - live, "segments": self.segments, "terms": self._live("postings").select("term").distinct().count()}

    def merge(self, root: str) -> SearchIndex:
        """A new index of one segment in another folder, with what is live here."""
        made = SearchIndex(self.spark, root, self.key, self.fields)
        rows = self._live("postings").drop("segment")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(parts, "bucket", "term", "key").sortWithinPartitions("bucket", "term", "key").write.partitionBy("bucket").parquet(f"{made.root}/postings/segment=0")
        self._live("docs").drop("segment").write.parquet(f"{made.root}/docs/segment=0")
        made.segments = 1
        return made
