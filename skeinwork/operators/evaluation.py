"""Retrieval quality over ranked results (query, rank, rel) and judged totals (query, relevant)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ranks import running


def ranked_measures(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """One row a query: precision and recall at k, average precision, reciprocal rank, NDCG at k. rel is the grade, 0 if not relevant."""
    hit = (F.col("rel") > 0).cast("int")
    each = running(ranked.select("query", "rank", "rel", hit.alias("hit")), "query", ["rank"], sums={"hit": "met"}).withColumn("running", F.col("met") / F.col("rank"))
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0)
    sums = each.groupBy("query").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("hits"), F.sum(F.col("running") * F.col("hit")).alias("ap_sum"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
    )
    ordered = running(judged.select("query", "rel", (-F.col("rel")).alias("worse")), "query", ["worse"], rank="i")
    ideal = ordered.groupBy("query").agg(F.count_if(F.col("rel") > 0).alias("relevant"), F.sum(F.when(F.col("i") <= k, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("idcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = F.col("hits") / k, F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0)
    return sums.join(ideal, "query", "left").select("query", p.alias("precision"), zero(r).alias("recall"), zero(F.when(F.col("relevant") > 0, F.col("ap_sum") / F.col("relevant"))).alias("ap"), zero(1 / F.col("first")).alias("rr"), zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"))


def evaluate(run: Callable[[str], DataFrame], gold: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """Measures of every gold query (query, doc, grade): each is run, giving (key, score), and judged; one row a query, and one of means named 'mean'."""
    texts = [r["query"] for r in gold.select("query").distinct().orderBy("query").collect()]  # a gold set is short
    ranked = None
    for t in texts:
        top = run(t).orderBy(F.desc("score"), key).limit(k)
        place = F.row_number().over(Window.orderBy(F.desc("score"), key))  # k rows
        one = top.select(F.lit(t).alias("query"), F.col(key).alias("doc"), place.alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    if ranked is None:
        ranked = gold.select("query", "doc", F.lit(1).alias("rank")).limit(0)
    judged = ranked.join(gold, ["query", "doc"], "left").select("query", "rank", F.coalesce("grade", F.lit(0)).alias("rel"))
    blank = gold.select("query").distinct().join(judged.select("query").distinct(), "query", "left_anti").select("query", F.lit(1).alias("rank"), F.lit(0).alias("rel"))
    each = ranked_measures(judged.unionByName(blank), gold.select("query", F.col("grade").alias("rel")), k)
    means = each.agg(*[F.avg(c).alias(c) for c in each.columns if c != "query"]).select(F.lit("mean").alias("query"), *[c for c in each.columns if c != "query"])
    return each.unionByName(means)


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.when((precision <= 0) | (recall <= 0), 0.0).otherwise((1 + b) * precision * recall / (b * precision + recall))
