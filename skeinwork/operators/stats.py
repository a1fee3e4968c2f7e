"""Column statistics: equi-depth histograms, selectivity, distinct counts, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ranks import global_rank

#: Fixed values of the cost model.
PAGE_IO, CPU_TUPLE, CPU_VECTOR, PAGE_ROWS = 1.0, 0.01, 0.1, 64
LEAST_SELECTIVITY = 0.001


def equi_depth(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """(bucket, min_val, max_val, n, n_distinct): slices of equal depth, the first n mod k one row larger; nulls are left out.

    Ranks come from a range partitioning and per-partition counts, so no single task sorts the column.
    """
    ranked = global_rank(df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v")), ["v"], "i", "n")
    k = F.least(F.lit(buckets).cast("long"), F.col("n"))
    small, extra = F.floor(F.col("n") / k), F.col("n") % k
    cut = extra * (small + 1)
    bucket = F.when(F.col("i") <= cut, F.floor((F.col("i") - 1) / (small + 1))).otherwise(extra + F.floor((F.col("i") - 1 - cut) / small)) + 1
    return ranked.groupBy(bucket.cast("int").alias("bucket")).agg(F.min("v").alias("min_val"), F.max("v").alias("max_val"), F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("n_distinct"))


def _below(value: Column, inclusive: bool) -> Column:
    """Rows of a bucket below value, by linear interpolation inside it."""
    width = F.col("max_val") - F.col("min_val")
    inside = F.when(width > 0, (value - F.col("min_val")) / width).otherwise(F.lit(1.0 if inclusive else 0.0))
    if not inclusive:  # the largest value itself isn't below
        inside = F.when((value == F.col("max_val")) & (F.col("n_distinct") > 1), (F.col("n_distinct") - 1.0) / F.col("n_distinct")).otherwise(inside)
    whole = (value > F.col("max_val")) | ((value == F.col("max_val")) if inclusive else F.lit(False))
    share = F.when(whole, F.lit(1.0)).when(value < F.col("min_val"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))
    # the first bucket that isn't wholly below is the last that counts
    first_open = F.col("bucket") == F.min(F.when(~whole, F.col("bucket"))).over(Window.partitionBy("probe"))
    return F.when(whole | first_open, share * F.col("n")).otherwise(0.0)


def selectivity(histogram: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, eq, lt, le, gt, ge) for each row (probe) of values against a histogram of at most a few buckets."""
    pairs = probes.crossJoin(F.broadcast(histogram))  # a histogram has a fixed number of rows
    v = F.col("probe")
    pairs = pairs.select("*", F.sum("n").over(Window.partitionBy("probe")).alias("total"), _below(v, False).alias("lt"), _below(v, True).alias("le"))
    hit = F.when((v >= F.col("min_val")) & (v <= F.col("max_val")), F.col("n") / F.col("total") / F.col("n_distinct")).otherwise(0.0)
    clamp = lambda c: F.greatest(F.lit(LEAST_SELECTIVITY), F.least(F.lit(1.0), c))
    sums = pairs.groupBy("probe").agg(F.sum(hit).alias("eq"), (F.sum("lt") / F.max("total")).alias("lt"), (F.sum("le") / F.max("total")).alias("le"))
    zero_one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return sums.select("probe", clamp(F.col("eq")).alias("eq"), clamp(F.col("lt")).alias("lt"), clamp(F.col("le")).alias("le"), zero_one(1 - clamp(F.col("le"))).alias("gt"), zero_one(1 - clamp(F.col("lt"))).alias("ge"))


def scan_cost(rows: Column) -> Column:
    return F.round(F.greatest(F.lit(1), F.floor(rows / PAGE_ROWS)) * PAGE_IO + rows * CPU_TUPLE, 3)


def index_cost(rows: Column, share: Column) -> Column:
    height = F.when(rows < 500, 1).when(rows < 10000, 2).otherwise(3)
    hits = F.greatest(F.lit(1), F.floor(rows * share))
    return F.round(height * PAGE_IO + F.greatest(F.lit(1), F.floor(hits / PAGE_ROWS)) * PAGE_IO + hits * CPU_TUPLE, 3)


def knn_cost(rows: Column, ef: int = 32) -> Column:
    return F.round(F.least(rows, F.lit(2 * ef)) * 16 * CPU_VECTOR, 3)


def hybrid_costs(rows: Column, share: Column, k: Column) -> tuple[Column, Column]:
    """(filter first, vector search first) in total; the smaller is the plan."""
    first = index_cost(rows, share) + F.greatest(F.lit(1), F.floor(rows * share)) * CPU_VECTOR
    return F.round(first, 3), F.round(knn_cost(rows) + k * 5 * CPU_TUPLE, 3)
