"""Graph queries over edges derived from orders, and retrieval measures over labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import graph as G
from .base import Section, table

S = Section()
query = S.query

#: Edges between nations: a customer's nation to its supplier's nation, from all orders.
EDGES = "(SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("dst"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("src", "dst").distinct()


_ROUND = "r{i} AS (SELECT n.id, 0.15 / 25 + 0.85 * coalesce(sum(p.rank / deg.out), 0) AS rank FROM nodes n LEFT JOIN e ON e.dst = n.id LEFT JOIN deg ON deg.src = e.src LEFT JOIN r{j} p ON p.id = e.src GROUP BY n.id)"


@query(f"WITH e AS MATERIALIZED {EDGES}, nodes AS (SELECT n_nationkey AS id FROM nation), deg AS (SELECT src, count(*)::DOUBLE AS out FROM e GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE / 25 AS rank FROM nodes), {', '.join(_ROUND.format(i=i, j=i - 1).replace('AS (', 'AS MATERIALIZED (', 1) for i in range(1, 21))} SELECT id, round(rank, 6) AS rank FROM r20")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return G.pagerank(nodes, edges(spark, d)).select("id", F.round(F.coalesce("rank", F.lit(G.ABSENT)), 6).alias("rank"))


#: A sparser graph: each nation to the one of its number doubled and one, modulo 23.
SPARSE = "(SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 23 AS dst FROM nation UNION SELECT n_nationkey, n_nationkey // 3 FROM nation WHERE n_nationkey % 3 = 0)"


def sparse(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 23).alias("dst")).union(n.filter("n_nationkey % 3 = 0").select("n_nationkey", F.expr("cast(n_nationkey div 3 as int)"))).distinct()


@query(f"WITH RECURSIVE e AS {SPARSE}, w(id, hops) AS (SELECT 4, 0 UNION ALL SELECT dst, hops + 1 FROM w JOIN e ON src = id WHERE hops < 2) SELECT id, min(hops)::INTEGER AS hops FROM w GROUP BY id")
def khop(spark: SparkSession, d: str) -> DataFrame:
    start = table(spark, d, "nation").filter("n_nationkey = 4").select(F.col("n_nationkey").alias("id"))
    return G.within_hops(sparse(spark, d), start, 2)


@query(f"WITH RECURSIVE e AS (SELECT * FROM {SPARSE} WHERE src <> dst), w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON w.dst = e.src) SELECT src AS id FROM w WHERE src = dst")
def cycle(spark: SparkSession, d: str) -> DataFrame:
    return G.on_cycles(sparse(spark, d)).select("id")


@query(f"WITH RECURSIVE e AS (SELECT * FROM {SPARSE} WHERE src <> dst), w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON w.dst = e.src) SELECT a.src AS id, max(a.dst) AS victim FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src WHERE a.src IN (SELECT src FROM w WHERE src = dst) GROUP BY a.src")
def cycle_victim(spark: SparkSession, d: str) -> DataFrame:
    """The transaction to abort for each one in a deadlock: the greatest that it shares cycles with."""
    return G.on_cycles(sparse(spark, d))


@query("SELECT p_brand AS entity, count(DISTINCT p_partkey) AS n_papers, min(p_partkey) AS first_paper FROM part GROUP BY p_brand")
def entity_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("entity")).agg(F.countDistinct("p_partkey").alias("n_papers"), F.min("p_partkey").alias("first_paper"))


@query(r"""WITH l AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS url, regexp_extract(split_part(split_part(url, '://', 2), '/', 1), '[^.]+\.[^.]+$') AS target FROM pages), c AS (SELECT DISTINCT url FROM l), n AS (SELECT url, count(*) AS n FROM l GROUP BY url),
  g AS (SELECT target, sum(1.0::DOUBLE / n) AS gain FROM l JOIN n USING (url) GROUP BY target)
  SELECT coalesce(url, target) AS url, round(CASE WHEN url IS NOT NULL THEN coalesce(gain, 0) ELSE 1 + gain END, 6) AS cash, CASE WHEN url IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS history FROM c FULL JOIN g ON url = target""")
def opic_round(spark: SparkSession, d: str) -> DataFrame:
    """Hosts hand their cash to their registered domains."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    links = table(spark, d, "pages").select(host.alias("url"), F.regexp_extract(host, r"[^.]+\.[^.]+$", 0).alias("target"))
    cash = links.select("url").distinct().select("url", F.lit(1.0).alias("cash"), F.lit(0.0).alias("history"))
    return G.opic_round(cash, links).select("url", F.round("cash", 6).alias("cash"), "history")


@query("SELECT lang AS keyword, count(*) AS n, array_to_string((list(doc_id ORDER BY doc_id))[1:50], '|') AS ids FROM documents GROUP BY lang")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    """One cluster a keyword with its first fifty documents: ranked first, so no group is gathered whole."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select(F.col("lang").alias("keyword"), "doc_id")
    first = docs.withColumn("r", F.row_number().over(Window.partitionBy("keyword").orderBy("doc_id"))).filter("r <= 50")
    ids = first.groupBy("keyword").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "|").alias("ids"))
    return docs.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).join(ids, "keyword").select("keyword", "n", "ids")


#: Each language is a query; its documents are ranked by length; relevance is quality, doubled if not toxic.
RANKED = """(SELECT lang AS query, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, coalesce(quality * (2 - toxic), 0) AS rel FROM documents LEFT JOIN labels USING (doc_id))"""
_MEASURES = f"""WITH r AS (SELECT *, (rel > 0)::INT AS hit, (sum((rel > 0)::INT) OVER (PARTITION BY query ORDER BY rank))::DOUBLE / rank AS running, row_number() OVER (PARTITION BY query ORDER BY rel DESC) AS ideal FROM {RANKED}),
  m AS (SELECT query, (sum(hit) FILTER (rank <= 10))::DOUBLE AS hits, sum(hit)::DOUBLE AS relevant, sum(running * hit) AS aps, min(CASE WHEN hit = 1 THEN rank END) AS first,
    sum((2 ** rel - 1) / log2(rank + 1)) FILTER (rank <= 10) AS dcg, sum((2 ** rel - 1) / log2(ideal + 1)) FILTER (ideal <= 10) AS idcg FROM r GROUP BY query) """


def measures(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.ranks import running

    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    graded = docs.select(F.col("lang").alias("query"), (-F.col("n_chars")).alias("short"), "doc_id", F.coalesce(F.col("quality") * (2 - F.col("toxic")), F.lit(0)).alias("rel"))
    ranked = running(graded, "query", ["short", "doc_id"], rank="rank").select("query", "rank", "rel")
    return E.ranked_measures(ranked, ranked.select("query", "rel"), 10)


@query(_MEASURES + "SELECT query, round(hits / 10, 6) AS value FROM m")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return measures(spark, d).select("query", F.round("precision", 6).alias("value"))


@query(_MEASURES + "SELECT query, round(hits / relevant, 6) AS value FROM m")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return measures(spark, d).select("query", F.round("recall", 6).alias("value"))


@query(_MEASURES + "SELECT query, round(CASE WHEN hits = 0 THEN 0 ELSE 5 * (hits / 10) * (hits / relevant) / (4 * hits / 10 + hits / relevant) END, 6) AS value FROM m")
def f_beta(spark: SparkSession, d: str) -> DataFrame:
    return measures(spark, d).select("query", F.round(E.f_beta(F.col("precision"), F.col("recall"), 2.0), 6).alias("value"))


@query(_MEASURES + "SELECT query, round(aps / relevant, 6) AS value FROM m")
def avg_precision(spark: SparkSession, d: str) -> DataFrame:
    return measures(spark, d).select("query", F.round("ap", 6).alias("value"))


@query(_MEASURES + "SELECT query, round(1.0 / first, 6)::DOUBLE AS value FROM m")
def mrr(spark: SparkSession, d: str) -> DataFrame:
    return measures(spark, d).select("query", F.round("rr", 6).alias("value"))


@query(_MEASURES + "SELECT query, round(dcg / idcg, 6) AS value FROM m")
def ndcg(spark: SparkSession, d: str) -> DataFrame:
    return measures(spark, d).select("query", F.round("ndcg", 6).alias("value"))
