"""Global ranks without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage


def global_rank(df: DataFrame, order: list[str], rank: str, total: str) -> DataFrame:
    """df with each row's 1-based place in the order of ``order`` (ascending) and the number of rows.

    Rows are range partitioned and sorted within partitions, and written once with their partition's number and their
    place in it: counted and joined from there, they can't be dealt by two samples of bounds. Only the partitions' counts,
    one row each, are summed up.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't coalesced, so partition ids hold
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    inside = (F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33) + 1).alias("_in")
    placed = stage(dealt.select("*", inside).drop("_id"), "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_part").alias("_at"), before.alias("_before"), F.sum("_n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total))
    joined = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_at"))  # one row a partition
    return joined.withColumn(rank, F.col("_before") + F.col("_in")).drop("_part", "_in", "_at", "_before")


def running(df: DataFrame, group: str, order: list[str], rank: str | None = None, sums: dict[str, str] | None = None, lags: dict[str, str] | None = None) -> DataFrame:
    """df with each row's place in its group (from 1), sums up to it and values of the row before it, in the order of ``order`` (ascending).

    sums, lags: column to new column; columns that are lagged hold no nulls. No task holds a whole group: rows are range
    partitioned by group and order and written once, windows run inside a partition's share of a group, and what lies
    before is carried over from the partitions' ends, for the groups that lie in several: two rows a partition at most.
    """
    sums, lags = sums or {}, lags or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    local = Window.partitionBy("_part", group).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    own = [F.row_number().over(local).cast("long").alias("_place"), *[F.sum(c).over(upto).alias(f"_sum_{n}") for c, n in sums.items()], *[F.lag(c).over(local).alias(f"_lag_{n}") for c, n in lags.items()]]
    at = F.struct(*order)
    ends = dealt.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{n}") for c, n in sums.items()], *[F.max_by(c, at).alias(f"_lag_{n}") for c, n in lags.items()])
    across = Window.partitionBy(group).orderBy("_part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("_part").alias("_at"), F.col(group).alias("_group"), F.sum("_n").over(before).alias("_before"), *[F.sum(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in sums.values()],
        *[F.lag(f"_lag_{n}").over(across).alias(f"_last_{n}") for n in lags.values()], F.count(F.lit(1)).over(Window.partitionBy(group)).alias("_spread"),
    ).filter("_spread > 1")
    met = dealt.select("*", *own).join(F.broadcast(carried), (F.col("_part") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    new = [(F.col("_place") + F.coalesce("_before", F.lit(0))).alias(rank)] if rank else []
    new += [(F.col(f"_sum_{n}") + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in sums.values()]
    new += [F.coalesce(f"_lag_{n}", f"_last_{n}").alias(n) for n in lags.values()]
    return met.select(*df.columns, *new)
