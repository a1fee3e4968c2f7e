"""Small helpers used by every operator here, on top of the library's staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import forget, fresh_path, shared_dir, stage

__all__ = ["forget", "fresh_path", "join_counted", "parts_for", "read_table", "row_count", "shared_dir", "stage"]

HOT_SHARE = 10_000
"""A key that holds more than one in so many rows is hot; there are fewer than this many hot keys."""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]


def parts_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_counted(rows: DataFrame, facts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows left joined with facts, which has one row a key and in ``n`` how many of the rows hold it.

    Facts of hot keys, fewer than HOT_SHARE of them whatever the data, are broadcast, so that their rows stay where they
    are; null keys meet nothing and stay as well; only the rest is shuffled. facts must be staged, it is read several times.
    """
    held = facts.agg(F.sum(n).alias("all"), F.max(n).alias("most")).first()
    limit = max(1000, (held["all"] or 0) // HOT_SHARE)
    is_hot = F.col(n) > limit
    if (held["most"] or 0) <= limit:
        hot = None
        cold = rows.filter(F.col(key).isNotNull())
    else:
        hot = F.broadcast(facts.filter(is_hot))
        cold = rows.filter(F.col(key).isNotNull()).join(F.broadcast(facts.filter(is_hot).select(key)), key, "left_anti")
    out = cold.join(facts.filter(~is_hot), key, "left")
    names = out.columns
    if hot is not None:
        out = out.unionByName(rows.join(hot, key).select(names))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema if f.name != key]
    return out.unionByName(rows.filter(F.col(key).isNull()).select("*", *blank).select(names))
