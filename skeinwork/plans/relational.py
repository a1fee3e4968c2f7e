"""Scans, predicates, ordering, joins, grouping and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Section, table

S = Section()
query = S.query


@query("SELECT count(*) AS n_rows, sum(l_orderkey)::BIGINT AS key_sum, sum(l_linenumber)::BIGINT AS line_sum FROM lineitem")
def scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_orderkey").alias("key_sum"), F.sum("l_linenumber").alias("line_sum"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 4000 AND o_orderstatus = 'F'")
def index_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(F.col("o_orderkey").between(100, 4000) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42 OR o_orderkey = -1")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(F.col("o_orderkey").isin(42, -1)).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-03-31").cast("timestamp_ntz")
    return table(spark, d, "orders").filter(F.col("o_orderdate").between(lo, hi)).select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer")
def project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name")


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%ring%' AND p_type LIKE '%N%'")
def like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_name").like("%ring%") & F.col("p_type").like("%N%")).select("p_partkey", "p_name", "p_type")


@query("""SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size > 10 AND p_size <= 40 AND p_retailprice BETWEEN 900 AND 1500
  AND p_size IN (12, 15, 20, 33, 40) AND p_partkey >= 5 AND p_partkey < 100000 AND contains(p_brand, '2')""")
def predicates(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    keep = (size > 10) & (size <= 40) & F.col("p_retailprice").between(900, 1500) & size.isin(12, 15, 20, 33, 40)
    keep = keep & (F.col("p_partkey") >= 5) & (F.col("p_partkey") < 100000) & F.col("p_brand").contains("2")
    return table(spark, d, "part").filter(keep).select("p_partkey", "p_size", "p_retailprice")


@query("""SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier
  WHERE NOT (s_nationkey IN (1, 2, 3) OR s_acctbal < 0) AND s_nationkey NOT IN (7) AND s_name IS NOT NULL ORDER BY s_suppkey LIMIT 50 OFFSET 3""")
def bool_pred(spark: SparkSession, d: str) -> DataFrame:
    keep = ~(F.col("s_nationkey").isin(1, 2, 3) | (F.col("s_acctbal") < 0)) & ~F.col("s_nationkey").isin(7) & F.col("s_name").isNotNull()
    return table(spark, d, "supplier").filter(keep).select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_suppkey").offset(3).limit(50)


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def order_by(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT n.n_name, r.r_name, n.n_nationkey FROM nation n JOIN region r ON n.n_regionkey >= r.r_regionkey AND n.n_nationkey < 10")
def nl_join(spark: SparkSession, d: str) -> DataFrame:
    """A theta join; the inner side is the region table, a fixed handful of rows."""
    n, r = table(spark, d, "nation").filter("n_nationkey < 10"), table(spark, d, "region")
    return n.join(r, F.col("n_regionkey") >= F.col("r_regionkey")).select("n_name", "r_name", "n_nationkey")


@query("SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice >= 300000")
def hash_join(spark: SparkSession, d: str) -> DataFrame:
    """The planner picks broadcast or shuffle by the sides' sizes."""
    o = table(spark, d, "orders").filter("o_totalprice >= 300000")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("""SELECT n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def multi_join(spark: SparkSession, d: str) -> DataFrame:
    near = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, d, "customer").join(near, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum_price FROM lineitem WHERE l_quantity >= 10 GROUP BY l_returnflag ORDER BY l_returnflag")
def group_by_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_quantity >= 10").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("sum_price")).orderBy("l_returnflag")


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size")
def group_by_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM orders")
def count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def vectorized_agg(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    charge = F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(charge), 2).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT event_id AS elem FROM events WHERE event_type <> 'click' EXCEPT SELECT event_id FROM events WHERE value < 10")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    """Adds less removes, as an observed-remove set reads."""
    e = table(spark, d, "events")
    return e.filter("event_type <> 'click'").select(F.col("event_id").alias("elem")).subtract(e.filter("value < 10").select("event_id"))


@query("SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events")
def row_number(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", "value", F.row_number().over(w).cast("long").alias("rank"))


@query("""SELECT * FROM (SELECT event_type, event_id, value, count(*) OVER (PARTITION BY event_type) AS total_hits,
  row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events WHERE value > 0) WHERE rank <= 10""")
def topk_window(spark: SparkSession, d: str) -> DataFrame:
    """Scores of zero or less are dropped; hits are counted before the cut. Counts are aggregated apart, so the rank filter stays a group limit."""
    e = table(spark, d, "events").filter("value > 0").select("event_type", "event_id", "value")
    best = e.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).cast("long")).filter("rank <= 10")
    return best.join(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("total_hits")), "event_type").select("event_type", "event_id", "value", "total_hits", "rank")


@query("SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def multi_sort(spark: SparkSession, d: str) -> DataFrame:
    """All customers in order."""
    return table(spark, d, "customer").select("c_mktsegment", "c_acctbal", "c_custkey").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@query("SELECT lang, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY lang ORDER BY doc_id), 0) AS gap FROM documents")
def doc_gaps(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.ranks import running

    before = running(table(spark, d, "documents").select("lang", "doc_id"), "lang", ["doc_id"], lags={"doc_id": "last"})
    return before.select("lang", "doc_id", (F.col("doc_id") - F.coalesce("last", F.lit(0))).alias("gap"))


@query("SELECT round(greatest(w, 0) / sum(greatest(w, 0)) OVER (), 9) AS share, k FROM (SELECT s_suppkey AS k, s_acctbal AS w FROM supplier)")
def normalize_weights(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("w"))
    total = w.agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("n"))
    return w.crossJoin(F.broadcast(total)).select(F.round(share, 9).alias("share"), "k")  # the total is one row


@query("SELECT o_orderpriority AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS percent FROM orders GROUP BY o_orderpriority")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return o.crossJoin(F.broadcast(table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total")))).select("category", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


@query("""SELECT coalesce(strftime(o_orderdate, '%Y'), 'all') AS year, coalesce(strftime(o_orderdate, '%Y-%m'), 'all') AS month, n, price FROM (
  SELECT NULL::TIMESTAMP AS o_orderdate, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders) UNION ALL
  SELECT strftime(o_orderdate, '%Y'), 'all', count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 1 UNION ALL
  SELECT strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y-%m'), count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 1, 2""")
def tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy").alias("year"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    r = o.rollup("year", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return r.select(F.coalesce("year", F.lit("all")).alias("year"), F.coalesce("month", F.lit("all")).alias("month"), "n", "price")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT c_custkey, sha256(c_name) AS sha, md5(c_name) AS md5, upper(substr(md5(c_name), 1, 8)) AS head FROM customer")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", F.sha2(name, 256).alias("sha"), F.md5(name).alias("md5"), F.upper(F.substring(F.md5(name), 1, 8)).alias("head"))


@query("""WITH b AS (SELECT c_custkey, c_name, [('0x' || x)::HUGEINT for x in regexp_extract_all(hex(encode(c_name)), '..')] AS bytes FROM customer)
  SELECT c_custkey, list_reduce(list_concat([14695981039346656037::HUGEINT], bytes), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::VARCHAR AS fnv FROM b""")
def fnv_hashes(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.hashing import fnv1a

    return table(spark, d, "customer").select("c_custkey", fnv1a(F.col("c_name")).cast("string").alias("fnv"))


_LAST = "(SELECT max(o_orderdate)::DATE FROM orders)"


@query(f"""SELECT 'run' AS tier, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders UNION ALL SELECT 'daily', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderdate::DATE = {_LAST}
  UNION ALL SELECT 'last ' || days || ' days', count(o_orderkey), round(coalesce(sum(o_totalprice), 0), 2) FROM (SELECT unnest([30, 90, 365]) AS days) LEFT JOIN orders ON date_diff('day', o_orderdate::DATE, {_LAST}) < days GROUP BY days""")
def trailing_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The run, its last day, and what trails it by 30, 90 and 365 days: all tiers from one row a day."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price"))
    last = o.agg(F.max("day").alias("last"))  # one row
    back = F.date_diff("last", "day")
    tiers = F.array(F.lit("run"), F.when(back == 0, "daily"), *[F.when(back < k, f"last {k} days") for k in (30, 90, 365)])
    each = o.crossJoin(F.broadcast(last)).select(F.explode(F.array_compact(tiers)).alias("tier"), "n", "price")
    return each.groupBy("tier").agg(F.sum("n").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query("SELECT n_nationkey, n_name FROM nation WHERE length(n_name) % 2 = 0 AND n_nationkey > 3")
def predicate_callback(spark: SparkSession, d: str) -> DataFrame:
    """A filter that only Python code knows, as an Arrow batch function; what columns can say is applied before it."""
    from ..operators.predicates import keep

    return keep(table(spark, d, "nation").filter("n_nationkey > 3").select("n_nationkey", "n_name"), lambda row: len(row["n_name"]) % 2 == 0)
