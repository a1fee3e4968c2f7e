"""Ranked retrieval as DataFrames, without an index: ``index`` has the stored one.

Scoring reads each text once: it is tokenised once a row, the term frequencies of the query's terms are counted inside
the row and written as a slim table, from which one row of corpus statistics is aggregated and all scores are taken; no
postings are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import stage

#: BM25's parameters and the fields' boosts.
K1, B = 1.5, 0.75
BOOSTS = {"id": 1.0, "title": 4.0, "author": 3.5, "keywords": 3.0, "tags": 2.5, "description": 2.0, "abstract": 2.0, "date": 1.0, "category": 1.0, "content": 1.0}
DEFAULT_BOOST = 1.0


def tokens(text: Column) -> Column:
    return T.words(F.lower(text))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row, however often it is used: what is above an explode isn't pushed through it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def idf(n: Column, df_: Column) -> Column:
    return F.when((n <= 0) | (df_ <= 0), 1.0).otherwise(F.log1p((n - df_ + 0.5) / (df_ + 0.5)))


def bm25_part(tf: Column, length: Column, average: Column) -> Column:
    average = F.when(average > 0, average).otherwise(1.0)
    return F.when(tf > 0, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))).otherwise(0.0)


def _is(word: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(word)


def bm25(df: DataFrame, key: str, fields: dict[str, float], terms: list[str] | dict[str, float], keep: list[str] | None = None) -> DataFrame:
    """(key, score[, keep]) of the documents that have a term in a field; fields: text column to boost. Lengths average over all documents."""
    tokened, names = df, {}
    for j, (c, boost) in enumerate(fields.items()):
        tokened = once(tokened, f"_t{j}", tokens(F.coalesce(F.col(c), F.lit(""))))
        names[f"_t{j}"] = boost
    return bm25_of_tokens(tokened, key, names, terms, keep)


def bm25_of_tokens(df: DataFrame, key: str, fields: dict[str, float], terms: list[str] | dict[str, float], keep: list[str] | None = None) -> DataFrame:
    """The same over columns of tokens; terms may have boosts."""
    terms = terms if isinstance(terms, dict) else dict.fromkeys(terms, 1.0)
    counts = [F.struct(F.size(c).alias("len"), *[F.size(F.filter(c, _is(w))).alias(f"t{i}") for i, w in enumerate(terms)]).alias(f"f{j}") for j, c in enumerate(fields)]
    counted = stage(df.select(key, *(keep or []), *counts), "term-counts")
    sums = [F.count(F.lit(1)).alias("n")]
    for j in range(len(fields)):
        sums += [F.sum(f"f{j}.len").alias(f"len{j}"), *[F.count_if(F.col(f"f{j}.t{i}") > 0).alias(f"df{j}_{i}") for i in range(len(terms))]]
    stats = counted.agg(*sums)  # one row
    score = F.lit(0.0)
    for j, boost in enumerate(fields.values()):
        for i, weight in enumerate(terms.values()):
            score = score + boost * weight * idf(F.col("n"), F.col(f"df{j}_{i}")) * bm25_part(F.col(f"f{j}.t{i}"), F.col(f"f{j}.len"), F.col(f"len{j}") / F.col("n"))
    any_hit = F.greatest(*[F.col(f"f{j}.t{i}") for j in range(len(fields)) for i in range(len(terms))], F.lit(0)) > 0
    return counted.filter(any_hit).crossJoin(F.broadcast(stats)).select(key, score.alias("score"), *(keep or []))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of positive score, ties by key."""
    return scored.filter("score > 0").orderBy(F.desc("score"), key).limit(k)


def tf_idf(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, term, weight, rank): the k terms of highest tf * ln(N / df) of each document."""
    tf = df.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    dfs = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    weighed = tf.join(dfs, "term").crossJoin(F.broadcast(n)).select(key, "term", F.round(F.col("tf") * F.ln(F.col("n") / F.col("df")), 6).alias("weight"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term")).cast("long")
    return weighed.withColumn("rank", rank).filter(F.col("rank") <= k)


def has_phrase(toks: Column, phrase: list[str], slop: int = 0) -> Column:
    """Whether the terms follow one another, each at most 1 + slop places after the one before.

    One pass over the tokens: what is kept is the last place up to which each beginning of the phrase has been met. A
    later place is never worse than an earlier one, so the last is enough.
    """
    never = -(1 << 30)

    def read(held: Column, token: Column) -> Column:
        now = held[0]
        met = [F.when((token == F.lit(w)) & (F.lit(True) if k == 0 else now - held[k] <= 1 + slop), now).otherwise(held[k + 1]) for k, w in enumerate(phrase)]
        return F.array(now + 1, *met)

    return F.aggregate(toks, F.array(F.lit(0), *[F.lit(never)] * len(phrase)), read)[len(phrase)] >= 0


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(term, df): in how many rows each term occurs."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def fuzzy(term: Column, word: str, edits: int) -> Column:
    """Within so many edits; lengths are compared first."""
    return (F.abs(F.length(term) - len(word)) <= edits) & (F.levenshtein(term, F.lit(word), edits) >= 0)


def wildcard(pattern: str) -> str:
    """A LIKE pattern of one with * and ?."""
    return pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")


def field_facet(df: DataFrame, value: Column, limit: int = 10, least: int = 1) -> DataFrame:
    """(value, n): counts of the values, most first, then by value."""
    return df.select(value.cast("string").alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "value").limit(limit)


def range_facet(df: DataFrame, value: str, start: int, end: int, gap: int) -> DataFrame:
    """(bucket, n): buckets from start by gap while below end; half-open but for the last; empty ones are kept."""
    spark = df.sparkSession
    buckets = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end - 1), F.lit(gap))).alias("lo")).select("lo", (F.col("lo") + gap).alias("hi"))
    last = start + (end - 1 - start) // gap * gap
    v = F.col(value).try_cast("double")
    at = F.when((v >= start) & (v <= last + gap), F.least(F.floor((v - start) / gap) * gap + start, F.lit(last)))
    counts = df.select(at.alias("at")).filter("at is not null").groupBy("at").agg(F.count(F.lit(1)).alias("c"))
    return buckets.join(counts, F.col("lo") == F.col("at"), "left").select(F.format_string("[%d TO %d]", "lo", "hi").alias("bucket"), F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def elevate(hits: DataFrame, key: str, promoted: list, excluded: list, loader: DataFrame | None = None) -> DataFrame:
    """(key, score): excluded hits go; promoted ones come first with scores from 1000 down, fetched from loader if not among the hits left."""
    kept = hits.filter(~F.col(key).isin(excluded)) if excluded else hits
    rule = hits.sparkSession.createDataFrame([(p, 1000.0 - i) for i, p in enumerate(promoted)], f"{key} {dict(hits.dtypes)[key]}, up double")
    there = kept.select(key) if loader is None else kept.select(key).unionByName(loader.select(key)).distinct()
    raised = F.broadcast(rule).join(there, key, "left_semi").select(key, F.col("up").alias("score"))  # a rule is a short list
    return raised.unionByName(kept.join(F.broadcast(rule), key, "left_anti").select(key, "score"))
