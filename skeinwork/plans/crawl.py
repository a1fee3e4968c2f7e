"""Crawl queries over pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .base import Section, table

S = Section()
query = S.query


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


@query()
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.normalize("url").alias("normal"))


#: URLs with a trap of each kind put in by number.
ODD = """url || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/a/b/a/c/a/' WHEN 2 THEN '/1/2/3/4/5/6/7/8/9' WHEN 3 THEN '?a=1&b=2&c=3&d=4&e=5&f=6&g=7' ELSE '/authors/x' END"""


@query(rf"""SELECT page_id, len(s) > 8 OR (len(s) >= 4 AND len([x for x in s if len([y for y in s if y = x]) >= 3]) > 0) OR len([x for x in string_split(regexp_extract(u, '\?([^#]*)', 1), '&') if regexp_matches(x, '^[^=]*=.')]) > 6
  OR regexp_matches(lower(p), '/(?:login|signin|signup|register|auth|admin|checkout|payment|password|reset)') AS is_trap
  FROM (SELECT *, [x for x in string_split(p, '/') if x <> ''] AS s FROM (SELECT page_id, u, regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS p FROM (SELECT page_id, {ODD} AS u FROM pages)))""")
def trap_detect(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 5
    odd = F.concat("url", F.when(k == 0, "").when(k == 1, "/a/b/a/c/a/").when(k == 2, "/1/2/3/4/5/6/7/8/9").when(k == 3, "?a=1&b=2&c=3&d=4&e=5&f=6&g=7").otherwise("/authors/x"))
    return pages(spark, d).select("page_id", U.is_trap(odd).alias("is_trap"))


STATE = """'<script id="__NEXT_DATA__" type="x">{"page": 1}</script><script type="application/ld+json">{"a": 2}</script><script>window.__INITIAL_STATE__ = {bad}; fetch("/api/items"); axios.get("/api/v1/papers"); x = "/v2/cve/9";</script>'"""


def scripted(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.concat("html", F.lit(STATE[1:-1])).alias("html"))


@query()
def hydration(spark: SparkSession, d: str) -> DataFrame:
    return scripted(spark, d).select("page_id", U.hydration("html").alias("s")).select("page_id", "s.next_data", "s.nuxt_data", "s.initial_state", F.size("s.json_ld").alias("n_json_ld"))


_PATTERNS = ", ".join("regexp_extract_all(h, '" + p.replace("'", "''") + "', 1)" for p in U.API_PATTERNS)


@query(f"SELECT page_id, array_to_string(list_sort(list_distinct(['https://x.org' || x for x in flatten([{_PATTERNS}])])), '|') AS endpoints FROM (SELECT page_id, html || {STATE} AS h FROM pages)")
def sniff_api(spark: SparkSession, d: str) -> DataFrame:
    return scripted(spark, d).select("page_id", F.array_join(U.api_paths("html", "https://x.org/"), "|").alias("endpoints"))


@query()
def css_select(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.array_join(U.css_select(F.col("html"), "article h1"), "|").alias("headings"), F.size(U.css_select(F.col("html"), "nav li a")).alias("n_links"), F.array_join(U.css_select(F.col("html"), "div.ad"), "|").alias("adverts"))


@query("""WITH f AS (SELECT url, max(page_id % 4) AS priority, min(page_id) AS seq FROM pages GROUP BY url), h AS (SELECT *, split_part(split_part(url, '://', 2), '/', 1) AS host FROM f)
  SELECT url, priority, row_number() OVER (ORDER BY priority DESC, seq) AS place, 0.5 * (row_number() OVER (PARTITION BY host ORDER BY priority DESC, seq) - 1)::DOUBLE AS wait FROM h""")
def frontier(spark: SparkSession, d: str) -> DataFrame:
    """Highest priority first, then first seen; a host's fetches are half a second apart."""
    from ..sources.ranks import global_rank

    first = pages(spark, d).groupBy("url").agg(F.max(F.col("page_id") % 4).alias("priority"), F.min("page_id").alias("seq"))
    placed = global_rank(first.withColumn("urgency", -F.col("priority")), ["urgency", "seq"], "place", "n")
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    wait = 0.5 * (F.row_number().over(Window.partitionBy(host).orderBy(F.desc("priority"), "seq")) - 1)
    return placed.select("url", "priority", "place", wait.alias("wait"))


@query(r"SELECT page_id, (CASE WHEN starts_with(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^#]*)', 1), '/en/') AND NOT starts_with(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^#]*)', 1), '/en/7') THEN 403 ELSE 200 END)::INTEGER AS status FROM pages")
def robots(spark: SparkSession, d: str) -> DataFrame:
    """Excluded URLs get a status of 403 without a fetch; every host has a robots.txt here, and each is read once."""
    body = F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/7\nDisallow: /en/\n")
    files = pages(spark, d).select(U.host("url").alias("host")).filter("host <> ''").distinct().withColumn("body", body)
    judged = U.with_permission(pages(spark, d), U.robot_rules(files))
    return judged.select("page_id", F.when(F.col("allowed"), 200).otherwise(403).alias("status"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def fetch_cache(spark: SparkSession, d: str) -> DataFrame:
    """What isn't among the pages already fetched."""
    seen = pages(spark, d).filter("page_id % 3 = 0").select("url")
    return pages(spark, d).join(seen, "url", "left_anti").select("page_id", "url")


@query("SELECT DISTINCT url FROM pages")
def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("url").distinct()


@query("""WITH RECURSIVE o AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  e(user_id, i, n, ema) AS (SELECT user_id, i, n, v FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.n, 0.85 * e.ema + 0.15 * o.v FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1)
  SELECT user_id, round(ema, 6) AS ema, round(greatest(0.2, least(30.0, 5 * ema)), 6) AS delay FROM e WHERE i = n""")
def autothrottle(spark: SparkSession, d: str) -> DataFrame:
    """A moving average of latencies by user, folded in order; the first is its own average. In closed form it is a weighted sum, so nothing is gathered."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    e = table(spark, d, "events").select("user_id", "value", (F.row_number().over(w) - 1).alias("back"), F.lead("event_id").over(w).isNull().alias("first"))
    part = F.pow(F.lit(0.85), F.col("back")) * F.col("value") * F.when(F.col("first"), 1.0).otherwise(0.15)
    ema = e.groupBy("user_id").agg(F.sum(part).alias("ema"))
    return ema.select("user_id", F.round("ema", 6).alias("ema"), F.round(F.greatest(F.lit(0.2), F.least(F.lit(30.0), 5 * F.col("ema"))), 6).alias("delay"))


@query("SELECT page_id, url IS NOT NULL AND html IS NOT NULL AND length(html) > 0 AS passes FROM pages")
def contract_check(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.contracts import meets

    return pages(spark, d).select("page_id", meets(["url", "html"], filled=["html"]).alias("passes"))


@query()
def domain_route(spark: SparkSession, d: str) -> DataFrame:
    ring = U.Ring(["node0", "node1", "node2"], virtual=100, mark="{node}:{i}", hash_="md5")
    return pages(spark, d).select("page_id", F.get(ring.assign(U.host("url")), F.lit(0)).alias("node"))


@query()
def shard_assign(spark: SparkSession, d: str) -> DataFrame:
    ring = U.Ring([f"node{i}" for i in range(5)])
    return table(spark, d, "orders").select("o_orderkey", ring.assign(F.col("o_orderkey").cast("string"), 3).alias("nodes"))


@query()
def rebalance(spark: SparkSession, d: str) -> DataFrame:
    """Keys that a sixth node takes on; old copies stay where they are."""
    old, new = U.Ring([f"node{i}" for i in range(5)]), U.Ring([f"node{i}" for i in range(6)])
    key = F.col("o_orderkey").cast("string")
    both = table(spark, d, "orders").select("o_orderkey", old.assign(key, 3).alias("old"), new.assign(key, 3).alias("new"))
    return both.filter(F.array_contains("new", "node5")).select("o_orderkey", F.array_union("old", "new").alias("holders"))
