"""Vector clocks and Merkle trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ranks import global_rank


def clock_merge(a: str, b: str) -> Column:
    """The larger counter of each node of two map columns; zeros are dropped."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))
    return F.map_filter(both, lambda _, n: n > 0)


def clock_relation(a: str, b: str) -> Column:
    """equal, before, after or concurrent; a missing node counts zero."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    below, above = F.exists(pairs, lambda p: p.x < p.y), F.exists(pairs, lambda p: p.x > p.y)
    return F.when(~below & ~above, "equal").when(~above, "before").when(~below, "after").otherwise("concurrent")


def merge_siblings(versions: DataFrame, merge: Callable[[list], object], kind: str, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value) with the siblings of each key made one by the caller's own function over their values, in order; a key's siblings are few, as dominated versions are gone."""

    @F.udf(kind)
    def run(values: list) -> object:
        return merge(values)

    return versions.groupBy(key).agg(run(F.array_sort(F.collect_list(value))).alias(value))


SUBTREE = 10


def merkle_root(df: DataFrame) -> DataFrame:
    """(root, leaves) of (key, value) strings: leaves are SHA-256 of key:value in key order, parents of their children's hashes.

    Subtrees of SUBTREE levels are folded within a row, so there is one shuffle for ten levels, and one row a subtree goes on.
    """
    level = global_rank(df, ["key"], "i", "n").select((F.col("i") - 1).alias("i"), F.sha2(F.concat_ws(":", "key", "value"), 256).alias("h"))
    leaves = n = level.count()
    if not n:
        return df.sparkSession.createDataFrame([(None, 0)], "root string, leaves bigint")
    while n > 1:
        deep = min(SUBTREE, (n - 1).bit_length())
        listed = level.groupBy(F.shiftright("i", deep).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("c"))  # 2 ** SUBTREE at most
        listed = listed.select("i", F.transform("c", lambda x: x["h"]).alias("c"))
        for _ in range(deep):
            pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("c") - 1) / 2).cast("int")), lambda j: F.slice("c", j * 2 + 1, F.lit(2)))
            parents = F.transform(pairs, lambda p: F.sha2(F.concat(p[0], F.coalesce(F.get(p, F.lit(1)), p[0])), 256))
            listed = listed.select("i", F.explode(F.array(parents)).alias("c"))  # worked out once: what is above an explode isn't pushed through it
        level = listed.select("i", F.col("c")[0].alias("h"))
        n = -(-n // (1 << deep))
    return level.select(F.col("h").alias("root"), F.lit(leaves).cast("long").alias("leaves"))
