"""Full-text queries, ranking, facets and the search pipeline over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fulltext as X
from ..operators.index import SearchIndex
from ..sources.staging import fresh_path
from .base import Section, table

S = Section()
query = S.query

_TOK = r"regexp_extract_all(lower(text), '[a-z0-9_\-]+')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def bm25_sql(terms: list[str], boost: float = 1.0) -> str:
    """Scores as a subquery (doc_id, score)."""
    parts = " + ".join(f"{boost} * ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * CASE WHEN t{i} > 0 THEN t{i} * 2.5 / (t{i} + 1.5 * (0.25 + 0.75 * l / avg_l)) ELSE 0 END" for i in range(len(terms)))
    tfs = ", ".join(f"len([x for x in toks if x = '{w}']) AS t{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (t{i} > 0) AS df{i}" for i in range(len(terms)))
    hit = " OR ".join(f"t{i} > 0" for i in range(len(terms)))
    return f"(WITH k AS (SELECT doc_id, len(toks)::DOUBLE AS l, {tfs} FROM (SELECT doc_id, {_TOK} AS toks FROM documents)), s AS (SELECT count(*)::DOUBLE AS n, sum(l) / count(*) AS avg_l, {dfs} FROM k) SELECT doc_id, {parts} AS score FROM k, s WHERE {hit})"


def index_of(spark: SparkSession, d: str) -> SearchIndex:
    return SearchIndex.build(docs(spark, d), fresh_path(spark, "index"), "doc_id", {"text": "text"})


def scores(spark: SparkSession, d: str, terms: list[str], boost: float = 1.0) -> DataFrame:
    return X.bm25(docs(spark, d), "doc_id", {"text": boost}, terms)


@query(f"SELECT doc_id, round(score, 6) AS score FROM {bm25_sql(['license', 'heat', 'and'])} ORDER BY score DESC, doc_id LIMIT 100")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return X.top(scores(spark, d, ["license", "heat", "and"]), "doc_id", 100).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM {bm25_sql(['inger'], 2.0)}")
def term_query(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d, ["inger"], 2.0).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, round(score * 3, 6) AS score FROM {bm25_sql(['inger'])}")
def boost_query(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d, ["inger"]).select("doc_id", F.round(F.col("score") * 3, 6).alias("score"))


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents")
def match_all(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.lit(1.0).alias("score"))


@query(f"""SELECT must.doc_id, round(must.score + coalesce(s.score, 0), 6) AS score FROM {bm25_sql(['the'])} must LEFT JOIN {bm25_sql(['heat'])} s ON s.doc_id = must.doc_id
  WHERE must.doc_id NOT IN (SELECT doc_id FROM documents WHERE list_contains({_TOK}, 'inger'))""")
def bool_query(spark: SparkSession, d: str) -> DataFrame:
    """MUST the, SHOULD heat, MUST NOT inger: one pass over the texts, the clauses decided within the row."""
    toked = X.once(docs(spark, d), "toks", X.tokens(F.coalesce("text", F.lit(""))))
    hits = X.bm25_of_tokens(toked.withColumn("banned", F.array_contains("toks", "inger")).withColumn("required", F.array_contains("toks", "the")), "doc_id", {"toks": 1.0}, ["the", "heat"], keep=["banned", "required"])
    return hits.filter("required and not banned").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH p AS (SELECT doc_id, unnest(range(0, len({_TOK}))) AS pos, unnest({_TOK}) AS term FROM documents)
  SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 2 WHERE a.term = 'of' AND b.term = 'the'""")
def phrase_query(spark: SparkSession, d: str) -> DataFrame:
    """of the, with slop 1; one pass over each row's tokens."""
    return docs(spark, d).filter(X.has_phrase(X.tokens(F.col("text")), ["of", "the"], 1)).select("doc_id")


@query(f"SELECT doc_id, round(score, 6) AS score FROM {bm25_sql(['license', 'heat', 'and'])} ORDER BY score DESC, doc_id LIMIT 100")
def indexed_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The scores of bm25 from a stored index: built, then read at the query's terms only."""
    return X.top(index_of(spark, d).search({"license": 1.0, "heat": 1.0, "and": 1.0}), "doc_id", 100).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH p AS (SELECT doc_id, unnest(range(0, len({_TOK}))) AS pos, unnest({_TOK}) AS term FROM documents)
  SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 3 JOIN p c ON c.doc_id = b.doc_id AND c.pos - b.pos BETWEEN 1 AND 3 WHERE a.term = 'the' AND b.term = 'of' AND c.term = 'the'""")
def indexed_phrase(spark: SparkSession, d: str) -> DataFrame:
    """the of the, with slop 2, from the positions of a stored index."""
    return index_of(spark, d).phrase(["the", "of", "the"], 2)


@query(f"""WITH k AS (SELECT doc_id, {_TOK} AS toks FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, {_TOK.replace('text', "text || ' heat heat'")} FROM documents WHERE doc_id % 7 = 0 AND doc_id % 2 = 0),
  f AS (SELECT doc_id, len(toks)::DOUBLE AS l, len([x for x in toks if x = 'heat']) AS t FROM k), s AS (SELECT count(*)::DOUBLE AS n, sum(l) / count(*) AS a, count(*) FILTER (t > 0) AS df FROM f)
  SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * t * 2.5 / (t + 1.5 * (0.25 + 0.75 * l / a)), 6) AS score FROM f, s WHERE t > 0""")
def index_update(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh document is deleted from the index by id, and the even ones of them are added again with a new text."""
    made, seventh = index_of(spark, d), docs(spark, d).filter("doc_id % 7 = 0")
    made.delete(seventh.select("doc_id"))
    made.add(seventh.filter("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit(" heat heat"))))
    return made.search({"heat": 1.0}).select("doc_id", F.round("score", 6).alias("score"))


_VOCAB = f"(SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term)"


@query(f"SELECT term, df FROM {_VOCAB} WHERE starts_with(term, 'lice')")
def prefix_query(spark: SparkSession, d: str) -> DataFrame:
    return X.vocabulary(docs(spark, d), "text").filter(F.col("term").startswith("lice"))


@query(f"SELECT term, df FROM {_VOCAB} WHERE term LIKE 'he_t%n'")
def wildcard_query(spark: SparkSession, d: str) -> DataFrame:
    return X.vocabulary(docs(spark, d), "text").filter(F.col("term").like(X.wildcard("he?t*n")))


@query(f"SELECT term, df, levenshtein(term, 'heater') AS edits FROM {_VOCAB} WHERE abs(length(term) - 6) <= 2 AND levenshtein(term, 'heater') <= 2")
def fuzzy_query(spark: SparkSession, d: str) -> DataFrame:
    hits = X.vocabulary(docs(spark, d), "text").filter(X.fuzzy(F.col("term"), "heater", 2))
    return hits.select("term", "df", F.levenshtein("term", F.lit("heater")).cast("long").alias("edits"))


@query(f"SELECT term, df FROM {_VOCAB} WHERE levenshtein(term, 'licence') <= 1 ORDER BY df DESC, term LIMIT 5")
def spell_suggest(spark: SparkSession, d: str) -> DataFrame:
    return X.vocabulary(docs(spark, d), "text").filter(X.fuzzy(F.col("term"), "licence", 1)).orderBy(F.desc("df"), "term").limit(5)


_TOPIC = "(SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content FROM documents)"


@query(r"""WITH k AS (SELECT doc_id, len(a)::DOUBLE AS la, len(b)::DOUBLE AS lb, len([x for x in a if x = 'the']) AS ta, len([x for x in b if x = 'the']) AS tb FROM
    (SELECT doc_id, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9_\-]+') AS a, regexp_extract_all(lower(text), '[a-z0-9_\-]+') AS b FROM documents)),
  s AS (SELECT count(*)::DOUBLE AS n, sum(la) / count(*) AS aa, sum(lb) / count(*) AS ab, count(*) FILTER (ta > 0) AS da, count(*) FILTER (tb > 0) AS db FROM k)
  SELECT doc_id, round(4.0 * ln(1 + (n - da + 0.5) / (da + 0.5)) * CASE WHEN ta > 0 THEN ta * 2.5 / (ta + 1.5 * (0.25 + 0.75 * la / aa)) ELSE 0 END
    + ln(1 + (n - db + 0.5) / (db + 0.5)) * CASE WHEN tb > 0 THEN tb * 2.5 / (tb + 1.5 * (0.25 + 0.75 * lb / ab)) ELSE 0 END, 6) AS score FROM k, s WHERE ta > 0 OR tb > 0""")
def multifield_bm25(spark: SparkSession, d: str) -> DataFrame:
    both = docs(spark, d).select("doc_id", T.title(F.col("text")).alias("title"), F.col("text").alias("content"))
    return X.bm25(both, "doc_id", {f: X.BOOSTS[f] for f in ("title", "content")}, ["the"]).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src3'")
def filter_query(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("lang = 'de' and source = 'src3'").select("doc_id")


@query("SELECT doc_id FROM documents WHERE lower(lang) = 'en' AND lower(source) = 'src5'")
def faceted_filter(spark: SparkSession, d: str) -> DataFrame:
    """Criteria combined by AND, letter case folded; a year that no document has is ignored."""
    from ..operators.facets import faceted_filter as keep

    years = docs(spark, d).select("doc_id", F.lit("2026").alias("year"), F.col("lang").alias("category"), F.array("source").alias("tags"), F.lit(None).cast("string").alias("domain"))
    return keep(years, year="1900", category=" EN", tag="SRC5").select("doc_id")


@query("SELECT unnest([lang, source]) AS tag, count(*) AS n FROM documents GROUP BY 1")
def tag_join(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.explode(F.array("lang", "source")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE list_contains([lang, source], 'src7')")
def docvalue_match(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter(F.array_contains(F.array("lang", "source"), "src7")).select("doc_id")


@query(f"""WITH h AS (SELECT * FROM {bm25_sql(['license'])} WHERE score > 0), p AS (SELECT unnest([3, 5, 8]) AS doc_id, unnest([1000.0, 999.0, 998.0]) AS up)
  SELECT doc_id::BIGINT AS doc_id, up::DOUBLE AS score FROM p UNION ALL SELECT doc_id, round(score, 6) FROM h WHERE doc_id NOT IN (3, 5, 8, 4, 8)""")
def elevation(spark: SparkSession, d: str) -> DataFrame:
    """8 is promoted and excluded: it comes back, since a loader is given."""
    hits = scores(spark, d, ["license"]).filter("score > 0").select("doc_id", F.round("score", 6).alias("score"))
    return X.elevate(hits, "doc_id", [3, 5, 8], [4, 8], loader=docs(spark, d).filter("doc_id in (3, 5, 8)"))


@query(f"SELECT doc_id, round(score, 6) AS score, doc_id % 3 AS shard, total_hits FROM (SELECT *, count(*) OVER () AS total_hits FROM {bm25_sql(['heat'])}) ORDER BY score DESC, doc_id LIMIT 10")
def shard_merge(spark: SparkSession, d: str) -> DataFrame:
    """Hits of three shards: totals are summed, then the best of all shards."""
    hits = scores(spark, d, ["heat"]).withColumn("shard", F.col("doc_id") % 3)
    total = hits.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("total_hits"))
    return X.top(hits, "doc_id", 10).crossJoin(F.broadcast(total)).select("doc_id", F.round("score", 6).alias("score"), "shard", "total_hits")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id % 4, doc_id) - 1 AS new_id FROM documents WHERE doc_id % 10 <> 0")
def segment_merge(spark: SparkSession, d: str) -> DataFrame:
    """Four segments without their deleted documents, renumbered in order."""
    from ..sources.ranks import global_rank

    live = docs(spark, d).filter("doc_id % 10 <> 0").select("doc_id", (F.col("doc_id") % 4).alias("segment"))
    return global_rank(live, ["segment", "doc_id"], "place", "n").select("doc_id", (F.col("place") - 1).alias("new_id"))


@query("SELECT doc_id, concat_ws(' ', lang, source, split_part(text, chr(10), 1)) AS _text_ FROM documents")
def copy_field(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.concat_ws(" ", "lang", "source", T.title(F.col("text"))).alias("_text_"))


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang")
def live_docs(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return docs(spark, d).join(gone, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT count(*) AS docs, count(*) - (SELECT count(*) FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)) AS live, (SELECT count(*) FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)) AS deleted,
  (SELECT count(*) FROM {_VOCAB}) AS terms FROM documents""")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("g"), F.lit(1).alias("hit"))
    counts = docs(spark, d).join(gone, F.col("doc_id") == F.col("g"), "left").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("hit").isNull()).alias("live"), F.count("hit").alias("deleted"))
    return counts.crossJoin(F.broadcast(X.vocabulary(docs(spark, d), "text").agg(F.count(F.lit(1)).alias("terms"))))


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, value LIMIT 10")
def field_facet(spark: SparkSession, d: str) -> DataFrame:
    return X.field_facet(docs(spark, d), F.col("source"))


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang ORDER BY n DESC, value LIMIT 20")
def facet_top20(spark: SparkSession, d: str) -> DataFrame:
    return X.field_facet(docs(spark, d).filter("lang <> ''"), F.col("lang"), limit=20)


@query("""SELECT '[' || lo || ' TO ' || (lo + 700) || ']' AS bucket, count(n_chars) AS n FROM (SELECT unnest(range(0, 5000, 700)) AS lo) b LEFT JOIN documents
  ON n_chars >= lo AND (n_chars < lo + 700 OR (lo = 4900 AND n_chars = 5600)) GROUP BY lo""")
def range_facet(spark: SparkSession, d: str) -> DataFrame:
    return X.range_facet(table(spark, d, "documents"), "n_chars", 0, 5000, 700)


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def multi_facet(spark: SparkSession, d: str) -> DataFrame:
    """All fields in one pass over the rows."""
    pairs = F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))).alias("field", "value")
    return docs(spark, d).select(pairs).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


@query(rf"SELECT round(sum(len({_TOK}))::DOUBLE / count(*), 6) AS text_len, round(sum(len(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9_\-]+')))::DOUBLE / count(*), 6) AS title_len FROM documents")
def avg_field_len(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.round(F.sum(F.size(X.tokens(c))) / F.count(F.lit(1)), 6)
    return docs(spark, d).agg(size(F.col("text")).alias("text_len"), size(T.title(F.col("text"))).alias("title_len"))


@query(f"""WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM {bm25_sql(['heat', 'the'])} ORDER BY r LIMIT 50),
  v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM (SELECT vec_id, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings) ORDER BY r LIMIT 50)
  SELECT coalesce(b.doc_id, v.doc_id) AS doc_id, round(coalesce(0.5 / (60 + b.r), 0) + coalesce(0.5 / (60 + v.r), 0), 6) AS rrf_score, b.r AS lexical_rank, v.r AS vector_rank FROM b FULL JOIN v ON b.doc_id = v.doc_id""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.vectors import knn, rrf

    e = table(spark, d, "embeddings")
    lexical = X.top(scores(spark, d, ["heat", "the"]), "doc_id", 50)
    near = knn(e, e.filter("vec_id = 0").select("embedding"), 50, raw=True).select(F.col("vec_id").alias("doc_id"), "score")
    return rrf(lexical, near, "doc_id").select("doc_id", "rrf_score", "lexical_rank", "vector_rank")


@query()
def select_handler(spark: SparkSession, d: str) -> DataFrame:
    """q, fq, rows and highlighting in one request."""
    from ..operators.pipeline import select

    return select(docs(spark, d), {"q": "heat license", "fq": "lang = 'en'", "rows": 20, "hl": True})


@query()
def search_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Understand, retrieve (lexical, and vectors of whole texts), fuse, present."""
    from ..operators.pipeline import search
    from ..operators.vectors import embed_column

    vectors = docs(spark, d).select("doc_id", embed_column("text").alias("vector"))
    return search(docs(spark, d), vectors, "heat +the -idiot", k=20)


