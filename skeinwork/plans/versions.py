"""Versioned data: upserts, snapshots, logs, replicas, clocks, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Section, table

S = Section()
query = S.query

#: events as a log of writes: key user_id, sequence event_id; every seventh entry deletes.
LOG = "(SELECT user_id AS k, event_id AS seq, round(value, 2) AS v, event_id % 7 = 0 AS gone FROM events)"


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.round("value", 2).alias("v"), (F.col("event_id") % 7 == 0).alias("gone"))


def latest(entries: DataFrame) -> DataFrame:
    """The last entry of each key that isn't a deletion: one aggregation with map-side combining, no window."""
    last = entries.groupBy("k").agg(F.max_by(F.struct("v", "gone", "seq"), "seq").alias("last"))
    return last.filter("not last.gone").select("k", "last.v", "last.seq")


@query(f"SELECT k, arg_max(v, seq) AS v, max(seq) AS seq FROM {LOG} GROUP BY k HAVING NOT arg_max(gone, seq)")
def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest(log(spark, d))


@query(f"SELECT k, arg_max(v, seq) AS v, max(seq) AS seq FROM {LOG} WHERE k >= 10 AND k < 60 GROUP BY k HAVING NOT arg_max(gone, seq) ORDER BY k")
def kv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Half-open range of keys, in key order."""
    return latest(log(spark, d).filter("k >= 10 and k < 60")).orderBy("k")


@query(f"SELECT k, arg_max(v, seq) AS v, max(seq) AS seq FROM {LOG} WHERE seq <= 500 GROUP BY k HAVING NOT arg_max(gone, seq)")
def mvcc_read(spark: SparkSession, d: str) -> DataFrame:
    """What a reader with snapshot 500 sees."""
    return latest(log(spark, d).filter("seq <= 500"))


@query("""SELECT page, arg_max(val, lsn) AS val FROM (SELECT user_id AS page, event_id AS lsn, round(value, 2) AS val, event_id % 50 AS tx FROM events)
  WHERE tx IN (SELECT event_id % 50 FROM events WHERE event_type = 'purchase') GROUP BY page""")
def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """Redo of committed transactions only: a transaction with a purchase entry has committed."""
    entries = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("lsn"), F.round("value", 2).alias("val"), (F.col("event_id") % 50).alias("tx"), "event_type")
    committed = entries.filter("event_type = 'purchase'").select("tx").distinct()
    return entries.join(committed, "tx", "left_semi").groupBy("page").agg(F.max_by("val", "lsn").alias("val"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT 10000000 + s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey = 3")
def insert(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "supplier").filter("s_nationkey = 3").select((F.lit(10000000) + F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").unionByName(new)


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("c_mktsegment") == "BUILDING"
    return table(spark, d, "customer").select("c_custkey", F.when(hit, F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def delete(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter(~F.coalesce(F.col("c_acctbal") < 0, F.lit(False))).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def rollback(spark: SparkSession, d: str) -> DataFrame:
    """A transaction that is rolled back leaves the snapshot it began from."""
    from ..sources.snapshots import SnapshotTable

    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return SnapshotTable.ephemeral(spark, base).transact(lambda t: t.filter("o_orderkey > 5"), commit=False)


@query("SELECT vec_id, label, len(embedding) AS dim FROM embeddings WHERE vec_id IN (7, 123456789)")
def get_by_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter(F.col("vec_id").isin(7, 123456789)).select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("""SELECT id, val FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM (
  SELECT c_custkey AS id, c_name AS val, 0 AS seq FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier)) WHERE r = 1""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("val"), F.lit(0).alias("seq"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("val"), F.lit(1).alias("seq"))
    return old.unionByName(new).groupBy("id").agg(F.max_by("val", "seq").alias("val"))


#: Two replicas of the events: A misses every fifth, B has older values of every third.
REPLICAS = """(SELECT event_id AS k, round(value, 2) AS v, 2 AS ts FROM events WHERE event_id % 5 <> 0) a FULL JOIN
  (SELECT event_id AS k, round(CASE WHEN event_id % 3 = 0 THEN value - 1 ELSE value END, 2) AS v, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS ts FROM events) b ON a.k = b.k"""


def replicas(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    old = F.col("event_id") % 3 == 0
    a = e.filter("event_id % 5 <> 0").select(F.col("event_id").alias("ka"), F.round("value", 2).alias("va"), F.lit(2).alias("ta"))
    b = e.select(F.col("event_id").alias("kb"), F.round(F.when(old, F.col("value") - 1).otherwise(F.col("value")), 2).alias("vb"), F.when(old, 1).otherwise(2).alias("tb"))
    return a.join(b, F.col("ka") == F.col("kb"), "full_outer")


@query(f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL OR a.ts >= b.ts THEN a.v ELSE b.v END AS v, (a.k IS NULL)::INT + (b.k IS NULL)::INT + coalesce((a.ts <> b.ts)::INT, 0) AS repaired FROM {REPLICAS}")
def anti_entropy(spark: SparkSession, d: str) -> DataFrame:
    """The newer value by key, and how many copies were written to make both replicas alike."""
    newer = F.when(F.col("kb").isNull() | (F.col("ta") >= F.col("tb")), F.col("va")).otherwise(F.col("vb"))
    repaired = F.col("ka").isNull().cast("int") + F.col("kb").isNull().cast("int") + F.coalesce((F.col("ta") != F.col("tb")).cast("int"), F.lit(0))
    return replicas(spark, d).select(F.coalesce("ka", "kb").alias("k"), newer.alias("v"), repaired.alias("repaired"))


@query(f"SELECT coalesce(a.k, b.k) AS k FROM {REPLICAS} WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v")
def merkle_diff(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose leaf hashes differ or that one side lacks."""
    leaf = lambda k, v: F.sha2(F.concat_ws(":", F.col(k).cast("string"), F.col(v).cast("string")), 256)
    return replicas(spark, d).filter(F.col("ka").isNull() | F.col("kb").isNull() | (leaf("ka", "va") != leaf("kb", "vb"))).select(F.coalesce("ka", "kb").alias("k"))


@query()
def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    """The root over sorted leaves, an odd node paired with itself; levels are aggregated pairwise, never gathered."""
    from ..operators.versions import merkle_root as root

    e = table(spark, d, "events")
    return root(e.select(F.col("event_id").cast("string").alias("key"), F.round("value", 2).cast("string").alias("value")))


@query(f"SELECT k, arg_max(v, seq * 10 + node) AS v, max(seq) AS seq FROM (SELECT *, k % 3 AS node FROM {LOG}) GROUP BY k")
def lww(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("k").agg(F.max_by("v", F.col("seq") * 10 + F.col("k") % 3).alias("v"), F.max("seq").alias("seq"))


@query("SELECT node, max(n)::BIGINT AS n FROM (SELECT 'n' || (user_id % 5) AS node, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 0 GROUP BY node")
def vclock_merge(spark: SparkSession, d: str) -> DataFrame:
    """Clocks of the event types over nodes, merged by the largest counter of each node; zeros are left out."""
    node = F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string"))
    counters = table(spark, d, "events").groupBy(node.alias("node"), "event_type").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    return counters.groupBy("node").agg(F.max("n").alias("n"))


#: A clock for each user: counters of the three event types most seen.
CLOCKS = """(SELECT user_id AS u, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b, count(*) FILTER (event_type = 'purchase') AS c
  FROM events GROUP BY user_id)"""


def clocks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seen = lambda kind: F.count_if(F.col("event_type") == kind)
    return e.groupBy(F.col("user_id").alias("u")).agg(seen("click").alias("a"), seen("view").alias("b"), seen("purchase").alias("c"))


@query(f"""SELECT x.u AS u, y.u AS w, CASE WHEN x.a = y.a AND x.b = y.b AND x.c = y.c THEN 'equal' WHEN x.a <= y.a AND x.b <= y.b AND x.c <= y.c THEN 'before'
  WHEN x.a >= y.a AND x.b >= y.b AND x.c >= y.c THEN 'after' ELSE 'concurrent' END AS relation FROM {CLOCKS} x JOIN {CLOCKS} y ON y.u = x.u + 1""")
def vclock_order(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.versions import clock_relation

    clock = F.create_map(F.lit("a"), "a", F.lit("b"), "b", F.lit("c"), "c")
    x, y = clocks(spark, d).select("u", clock.alias("x")), clocks(spark, d).select((F.col("u") - 1).alias("before"), F.col("u").alias("w"), clock.alias("y"))
    return x.join(y, F.col("u") == F.col("before")).select("u", "w", clock_relation("x", "y").alias("relation"))


@query(f"SELECT u FROM {CLOCKS} x WHERE NOT EXISTS (SELECT 1 FROM {CLOCKS} y WHERE y.u % 4 = x.u % 4 AND x.a <= y.a AND x.b <= y.b AND x.c <= y.c AND ((x.a, x.b, x.c) <> (y.a, y.b, y.c) OR y.u < x.u))")
def frontier_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions that no other of their key (u modulo 4) dominates; of equal ones the first.

    Of the versions alike in key, a and b only the one with most c, or the first of those, can stay; so what is compared
    grows with the counters' values, not with the users.
    """
    most = F.max(F.struct("c", (-F.col("u")).alias("n"))).alias("m")
    x = clocks(spark, d).groupBy((F.col("u") % 4).alias("g"), "a", "b").agg(most).select("g", "a", "b", F.col("m.c").alias("c"), (-F.col("m.n")).alias("u"))
    y = x.select(F.col("g").alias("h"), F.col("a").alias("p"), F.col("b").alias("q"), F.col("c").alias("r"))
    covered = (F.col("a") <= F.col("p")) & (F.col("b") <= F.col("q")) & (F.col("c") <= F.col("r"))
    other = (F.col("a") != F.col("p")) | (F.col("b") != F.col("q"))
    return x.join(y, (F.col("g") == F.col("h")) & covered & other, "left_anti").select("u")


@query("SELECT node, sum(CASE WHEN sign = 'p' THEN n ELSE -n END)::BIGINT AS value FROM (SELECT user_id % 3 AS node, CASE WHEN event_id % 4 = 0 THEN 'm' ELSE 'p' END AS sign, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY node")
def pn_counter(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("event_id") % 4 == 0, "m").otherwise("p")
    n = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("node"), sign.alias("sign")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("node").agg(F.sum(F.when(F.col("sign") == "p", F.col("n")).otherwise(-F.col("n"))).alias("value"))


@query("""SELECT k, arg_max(v, ts) AS v, count(*) AS replies FROM (SELECT user_id AS k, event_id % 3 AS node, max(event_id) AS ts, arg_max(round(value, 2), event_id) AS v FROM events WHERE event_id % 3 <> 2 GROUP BY 1, 2)
  GROUP BY k HAVING count(*) >= 2""")
def quorum_read(spark: SparkSession, d: str) -> DataFrame:
    """Reads of two replies out of three replicas, one of which is down; the newest reply wins."""
    up = table(spark, d, "events").select(F.col("user_id").alias("k"), (F.col("event_id") % 3).alias("node"), "event_id", F.round("value", 2).alias("v")).filter("node <> 2")
    replies = up.groupBy("k", "node").agg(F.max("event_id").alias("ts"), F.max_by("v", "event_id").alias("v"))
    return replies.groupBy("k").agg(F.max_by("v", "ts").alias("v"), F.count(F.lit(1)).alias("replies")).filter("replies >= 2")


@query("SELECT event_id, user_id % 3 AS node FROM events WHERE user_id % 3 NOT IN (SELECT DISTINCT user_id % 3 FROM events WHERE event_type = 'click' AND user_id % 3 <> 1)")
def hints(spark: SparkSession, d: str) -> DataFrame:
    """Writes held back for nodes that aren't online; a node other than 1 with a click is online."""
    e = table(spark, d, "events").withColumn("node", F.col("user_id") % 3)
    online = e.filter("event_type = 'click' and node <> 1").select("node").distinct()
    return e.join(online, "node", "left_anti").select("event_id", "node")
