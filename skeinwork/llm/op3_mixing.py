"""Operator 3: mixing sources to target weights, in DataFrame operations only.

Sizes are summed by source; a source's target is its weighted share of the mix, at most ``limit`` times its size, and
what is over goes to the others by weight until none is above. With level x the share of one weight, source s gets
min(cap_s, x * w_s); x is the largest of (mix - caps of the first m) / (weights of the rest) over the sources in order
of cap / weight. A source's repetition rate is target / size; every document is emitted floor(rate) times and once more
if a hash of its key falls below the rate's fraction, so reruns agree and a document's copies don't depend on others.

Null text has size 0; a null source is a source of its own, last in order; sources of size 0 have target 0. Rows with
one key (repeated rows) draw alike. Empty tables give empty tables; other columns are ignored by ``plan_mix`` and kept
by ``mix_rows``. Only the table of sources, one row each, is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, share: int = 150, limit: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(mix_source, source_size, target) with one row for each source of (source, size) rows; share in percent."""
    total = sizes.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last()))
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = total.select("*", F.get(listed, (place - 1) % len(weights)).cast("long").alias("w"), (F.col("source_size") * limit).alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("mix_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = ranked.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"), (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open"), F.sum("source_size").over(every).alias("all"))
    level = (F.col("all") * share - F.col("capped") * 100).cast("double") / (F.col("open") * 100).cast("double")
    return left.withColumn("level", level).withColumn("level", F.max("level").over(every)).select("mix_source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def draw(key: str, seed: str = "mix") -> Column:
    """A number in [0, 1) from a hash of the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(df: DataFrame, targets: DataFrame, key: str, source: str) -> DataFrame:
    """df with source_size, target and copies. The sources join by size: broadcast while small, else a join that AQE splits where skewed."""
    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    extra = (draw(key) < rate - F.floor(rate)).cast("long")
    return df.join(targets, F.col(source).eqNullSafe(F.col("mix_source"))).withColumn("copies", F.coalesce(F.floor(rate) + extra, F.lit(0)).cast("long")).drop("mix_source")


def plan_mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken, copies) of every row of df."""
    slim = stage(df.select(key, F.col(source).alias("source_"), words_in(text).alias("size")), "sizes")
    targets = stage(source_targets(slim, "source_", "size"), "targets")
    return with_copies(slim, targets, key, "source_").select(key, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of df as often as its copies say, with df's columns."""
    sizes = df.select(F.col(source).alias("source_"), words_in(text).alias("size"))
    targets = stage(source_targets(sizes, "source_", "size").selectExpr("mix_source", "source_size as mix_size", "target as mix_target"), "targets")
    own = [F.col(f"row.{c}").alias(c) for c in df.columns]
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(key).alias("mix_key"), F.col(source).alias("mix_of"))
    placed = with_copies(rows, targets.withColumnsRenamed({"mix_size": "source_size", "mix_target": "target"}), "mix_key", "mix_of")
    return placed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*own)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w, 2 * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0)::BIGINT AS capped, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS open, sum(source_size) OVER () AS total
      FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT max((total * 150 - capped * 100)::BIGINT::DOUBLE / (open * 100)::DOUBLE) AS level FROM c),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target FROM c, x),
m AS (SELECT doc_id, size, source_size, target, target / nullif(source_size, 0)::DOUBLE AS rate,
             ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, coalesce(floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT, 0)::BIGINT AS copies FROM m)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM k
"""
