"""Statistics, costs, telemetry, roll-ups and event windows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stats as P
from .base import Section, table

S = Section()
query = S.query

_HIST = "(SELECT ntile(10) OVER (ORDER BY l_quantity) AS bucket, l_quantity AS v FROM lineitem)"


@query(f"SELECT bucket::INTEGER AS bucket, min(v) AS min_val, max(v) AS max_val, count(*) AS n, count(DISTINCT v) AS n_distinct FROM {_HIST} GROUP BY bucket")
def equi_depth(spark: SparkSession, d: str) -> DataFrame:
    return P.equi_depth(table(spark, d, "lineitem"), "l_quantity")


@query(f"""WITH h AS (SELECT bucket, min(v) AS lo, max(v) AS hi, count(*)::DOUBLE AS n, count(DISTINCT v) AS nd FROM {_HIST} GROUP BY bucket), p AS (SELECT unnest([1.0, 7.5, 20.0, 33.25, 50.0, 99.0, -1.0])::DOUBLE AS probe), t AS (SELECT sum(n) AS total FROM h),
  x AS (SELECT probe, bucket, n, lo, hi, nd, probe > hi AS over, probe > hi OR probe = hi AS over_eq FROM p, h),
  y AS (SELECT *, bucket = min(CASE WHEN NOT over THEN bucket END) OVER (PARTITION BY probe) AS here, bucket = min(CASE WHEN NOT over_eq THEN bucket END) OVER (PARTITION BY probe) AS here_eq FROM x),
  z AS (SELECT probe, sum(CASE WHEN probe BETWEEN lo AND hi THEN n / (SELECT total FROM t) / nd ELSE 0 END) AS eq,
    sum(CASE WHEN over THEN n WHEN here AND probe >= lo THEN n * CASE WHEN hi = lo THEN 0 WHEN probe = hi AND nd > 1 THEN (nd - 1.0) / nd ELSE (probe - lo) / (hi - lo) END ELSE 0 END) / (SELECT total FROM t) AS lt,
    sum(CASE WHEN over_eq THEN n WHEN here_eq AND probe >= lo THEN n * CASE WHEN hi = lo THEN 1 ELSE (probe - lo) / (hi - lo) END ELSE 0 END) / (SELECT total FROM t) AS le FROM y GROUP BY probe),
  c AS (SELECT probe, greatest(0.001, least(1.0, eq)) AS eq, greatest(0.001, least(1.0, lt)) AS lt, greatest(0.001, least(1.0, le)) AS le FROM z)
  SELECT probe, round(eq, 6) AS eq, round(lt, 6) AS lt, round(le, 6) AS le, round(1 - le, 6) AS gt, round(1 - lt, 6) AS ge FROM c""")
def selectivity(spark: SparkSession, d: str) -> DataFrame:
    probes = spark.createDataFrame([(x,) for x in (1.0, 7.5, 20.0, 33.25, 50.0, 99.0, -1.0)], "probe double")
    out = P.selectivity(P.equi_depth(table(spark, d, "lineitem"), "l_quantity"), probes)
    return out.select("probe", *[F.round(c, 6).alias(c) for c in ("eq", "lt", "le", "gt", "ge")])


@query("""SELECT op, CASE op WHEN '=' THEN greatest(0.001, least(1.0, 1.0 / ndv)) WHEN 'IN' THEN least(1.0, 3.0 / ndv) WHEN 'LIKE' THEN 0.2 WHEN 'CONTAINS' THEN 0.2 WHEN 'OTHER' THEN 0.5 ELSE 0.33 END::DOUBLE AS share
  FROM (SELECT unnest(['=', '<', '<=', '>', '>=', 'LIKE', 'CONTAINS', 'IN', 'OTHER']) AS op), (SELECT count(DISTINCT p_brand)::DOUBLE AS ndv FROM part)""")
def fallback_sel(spark: SparkSession, d: str) -> DataFrame:
    """Shares guessed without a histogram, from the number of distinct values."""
    ops = spark.createDataFrame([(o,) for o in ("=", "<", "<=", ">", ">=", "LIKE", "CONTAINS", "IN", "OTHER")], "op string")
    ndv = table(spark, d, "part").agg(F.countDistinct("p_brand").cast("double").alias("ndv"))
    op = F.col("op")
    share = F.when(op == "=", F.greatest(F.lit(P.LEAST_SELECTIVITY), F.least(F.lit(1.0), 1 / F.col("ndv")))).when(op == "IN", F.least(F.lit(1.0), 3 / F.col("ndv"))).when(op.isin("LIKE", "CONTAINS"), 0.2).when(op == "OTHER", 0.5).otherwise(0.33)
    return ops.crossJoin(F.broadcast(ndv)).select("op", share.alias("share"))


@query("SELECT count(*) AS total, count(*) - count(p_size) AS nulls, count(DISTINCT p_size) AS ndv, min(p_size) AS min_val, max(p_size) AS max_val FROM part")
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("p_size").isNull()).alias("nulls"), F.countDistinct("p_size").alias("ndv"), F.min("p_size").alias("min_val"), F.max("p_size").alias("max_val"))


_SIZES = "(SELECT unnest([100, 640, 5000, 20000, 1000000]) AS n)"
_INDEX = "CASE WHEN n < 500 THEN 1 WHEN n < 10000 THEN 2 ELSE 3 END + greatest(1, floor(greatest(1, floor(n * s)) / 64)) + greatest(1, floor(n * s)) * 0.01::DOUBLE"


@query(f"SELECT n::BIGINT AS n, round(greatest(1, n // 64) + n * 0.01::DOUBLE, 3) AS scan, round({_INDEX}, 3)::DOUBLE AS idx, round(least(n, 64) * 16 * 0.1::DOUBLE, 3) AS knn FROM (SELECT n, 0.02::DOUBLE AS s FROM {_SIZES})")
def cost_model(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    rows = spark.createDataFrame([(x,) for x in (100, 640, 5000, 20000, 1000000)], "n bigint")
    return rows.select("n", P.scan_cost(n).alias("scan"), P.index_cost(n, F.lit(0.02)).alias("idx"), P.knn_cost(n).alias("knn"))


@query(f"""SELECT n::BIGINT AS n, s AS share, CASE WHEN a < b THEN 'filter_first' ELSE 'knn_first' END AS plan, round(least(a, b), 3) AS cost FROM (SELECT n, s, round({_INDEX}, 3)::DOUBLE + greatest(1, floor(n * s)) * 0.1::DOUBLE AS a, round(least(n, 64) * 16 * 0.1::DOUBLE, 3) + 10 * 5 * 0.01::DOUBLE AS b
  FROM {_SIZES}, (SELECT unnest([0.001, 0.02, 0.3])::DOUBLE AS s))""")
def hybrid_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(n, s) for n in (100, 640, 5000, 20000, 1000000) for s in (0.001, 0.02, 0.3)], "n bigint, share double")
    a, b = P.hybrid_costs(F.col("n"), F.col("share"), F.lit(10))
    return rows.select("n", "share", F.when(a < b, "filter_first").otherwise("knn_first").alias("plan"), F.least(a, b).alias("cost"))


@query()
def hll_ndv(spark: SparkSession, d: str) -> DataFrame:
    """Mergeable sketches by status, their union's estimate, and the exact count."""
    o = table(spark, d, "orders")
    parts = o.groupBy("o_orderstatus").agg(F.hll_sketch_agg("o_custkey", 12).alias("sketch"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")).crossJoin(o.agg(F.countDistinct("o_custkey").alias("exact")))


@query()
def bloom_filter(spark: SparkSession, d: str) -> DataFrame:
    """Keys of part that may be among the bought ones, by a Bloom filter's bits."""
    from ..operators.bloom import Bloom

    bought = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("k"))
    bloom = Bloom.for_rows(bought.distinct().count(), 0.01).fit(bought, "k")
    return bloom.probe(table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("k")), "k").select("p_partkey", "maybe")


@query()
def explain(spark: SparkSession, d: str) -> DataFrame:
    """The physical plan as rows."""
    plan = table(spark, d, "orders").filter("o_orderkey < 100").groupBy("o_orderstatus").count()
    text = plan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines()) if line.strip()], "addr int, step string")


@query("""WITH q AS (SELECT event_type AS topic, user_id, least(1.0, value / 100) AS ndcg FROM events) SELECT topic, count(*) AS n, round(avg(ndcg), 6) AS mean_ndcg, round(greatest(0.0, (1 - avg(ndcg)) * ln(1 + count(*))), 6) AS gap, round(count(*)::DOUBLE / (SELECT count(*) FROM q), 6) AS drift FROM q GROUP BY topic""")
def knowledge_gap(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "events").select(F.col("event_type").alias("topic"), F.least(F.lit(1.0), F.col("value") / 100).alias("ndcg"))
    topics = q.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.avg("ndcg").alias("m"))
    total = topics.agg(F.sum("n").alias("total"))
    gap = F.greatest(F.lit(0.0), (1 - F.col("m")) * F.log1p("n"))
    return topics.crossJoin(F.broadcast(total)).select("topic", "n", F.round("m", 6).alias("mean_ndcg"), F.round(gap, 6).alias("gap"), F.round(F.col("n") / F.col("total"), 6).alias("drift"))


@query("""SELECT 'run' AS tier, 'all' AS topic, count(*) AS sources, least(1.0, 0.7 + 0.05 * count(*))::DOUBLE AS confidence FROM documents UNION ALL SELECT 'daily', lang, count(*), 0.9::DOUBLE FROM documents GROUP BY lang""")
def topic_products(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "documents").groupBy(F.col("lang").alias("topic")).agg(F.count(F.lit(1)).alias("sources"))
    run = topics.agg(F.sum("sources").alias("sources")).select(F.lit("run").alias("tier"), F.lit("all").alias("topic"), "sources", F.least(F.lit(1.0), 0.7 + 0.05 * F.col("sources")).alias("confidence"))
    return run.unionByName(topics.select(F.lit("daily").alias("tier"), "topic", "sources", F.lit(0.9).alias("confidence")))


@query("SELECT lang || '/' || s AS source, i::INTEGER AS item FROM (SELECT DISTINCT lang FROM documents), (SELECT unnest(['atom', 'rss']) AS s), (SELECT unnest(range(1, 11)) AS i)")
def harvest(spark: SparkSession, d: str) -> DataFrame:
    """Ten items for each topic and source: a plan of the directive's size, not of the corpus'."""
    topics = table(spark, d, "documents").select("lang").distinct()
    plan = topics.select("lang", F.explode(F.array(F.lit("atom"), F.lit("rss"))).alias("s")).select(F.concat_ws("/", "lang", "s").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("item"))
    return plan


@query("""WITH g AS (SELECT user_id, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL THEN greatest(0.001, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) END AS gap FROM events)
  SELECT user_id, event_id, round(coalesce(avg(gap) OVER w, 1.0), 4) AS mean_gap, round(greatest(0.05, coalesce(stddev_pop(gap) OVER w, 0.05)), 3) AS std_gap FROM g WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""")
def phi_window(spark: SparkSession, d: str) -> DataFrame:
    return gaps(spark, d).select("user_id", "event_id", F.round("mean_gap", 4).alias("mean_gap"), F.round("std_gap", 3).alias("std_gap"))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of a user's last thousand heartbeat intervals."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    g = table(spark, d, "events").select("user_id", "event_id", seconds.alias("at"), (seconds - F.lag(seconds).over(order)).alias("raw"))
    g = g.withColumn("gap", F.when(F.col("raw").isNotNull(), F.greatest(F.lit(0.001), F.col("raw"))))
    last = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-999, 0)
    return g.select("user_id", "event_id", "at", F.coalesce(F.avg("gap").over(last), F.lit(1.0)).alias("mean_gap"), F.greatest(F.lit(0.05), F.coalesce(F.stddev_pop("gap").over(last), F.lit(0.05))).alias("std_gap"))


@query()
def phi(spark: SparkSession, d: str) -> DataFrame:
    """Suspicion of each user an hour after the last heartbeat."""

    @F.pandas_udf("double")
    def suspicion(y: pd.Series) -> pd.Series:
        return y.map(phi_of)

    last = gaps(spark, d).groupBy("user_id").agg(F.max_by(F.struct("at", "mean_gap", "std_gap"), "event_id").alias("s"))
    y = (3600.0 - F.col("s.mean_gap")) / (F.col("s.std_gap") * math.sqrt(2))
    return last.select("user_id", suspicion(y).alias("phi"))


def phi_of(y: float) -> float:
    """-log10 of the chance of a longer silence; far out the tail's asymptote, at most 16 where the chance vanishes."""
    if y > 10:
        return (y * y + math.log(y * math.sqrt(math.pi)) + math.log(2)) / math.log(10)
    p = 0.5 * math.erfc(y)
    return 16.0 if p <= 1e-15 else max(0.0, -math.log10(p))


def stamped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


def shown(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = stamped(spark, d).groupBy(F.window("at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(shown("window.start").alias("start"), "event_type", "n", "total")


@query("SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return stamped(spark, d).groupBy(F.window("at", "1 hour", "30 minutes")).agg(F.count(F.lit(1)).alias("n")).select(shown("window.start").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT, 1) AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    s = stamped(spark, d).groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", shown("w.start").alias("start"), "n")
