"""Text analysis, tagging and security scans over documents and pages. Lists are shown joined by |."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tagging as G
from ..functions import text as T
from .base import Section, table

S = Section()
query = S.query

_CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"
_MIXED = "'Ransomware 攻撃' || doc_id || ' arXiv:2608.12345 脆弱性診断 of the ' || text"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with some Japanese put before them."""
    return docs(spark, d).select("doc_id", F.concat(F.lit("Ransomware 攻撃"), F.col("doc_id").cast("string"), F.lit(" arXiv:2608.12345 脆弱性診断 of the "), F.col("text")).alias("s"))


def joined(c, name: str):
    return F.array_join(c, "|").alias(name)


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS plain FROM pages""")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query("SELECT doc_id, replace(replace(text, 'ß', 'ss'), 'œ', 'oe') AS mapped FROM documents")
def char_map(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.map_chars(F.col("text"), {"ß": "ss", "œ": "oe"}).alias("mapped"))


@query(rf"""SELECT doc_id, array_to_string(list_concat(regexp_extract_all(s, '[a-zA-Z0-9_\-]+'), flatten([list_concat([r], [substr(r, i, 2) for i in range(1, length(r))]) for r in regexp_extract_all(s, '{_CJK}')])), '|') AS tokens
  FROM (SELECT doc_id, {_MIXED} AS s FROM documents)""")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d).select("doc_id", joined(T.standard_tokens(F.col("s")), "tokens"))


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all(s, '[a-zA-Z0-9_\-.]*[a-zA-Z0-9_\-]'), '|') AS tokens FROM (SELECT doc_id, {_MIXED} AS s FROM documents)")
def tokenize_dotted(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d).select("doc_id", joined(T.all_matches(F.col("s"), T.DOTTED_WORD), "tokens"))


@query(rf"SELECT doc_id, array_to_string(flatten([[substr(r, i, 2) for i in range(1, length(r))] for r in regexp_extract_all(s, '{_CJK}')]), '|') AS tokens FROM (SELECT doc_id, {_MIXED} AS s FROM documents)")
def cjk_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d).select("doc_id", joined(F.flatten(F.transform(T.all_matches(F.col("s"), T.CJK_RUN), lambda r: T.grams(r, 2))), "tokens"))


@query(rf"""SELECT doc_id, array_to_string(list_concat(regexp_extract_all(lower(s), '[a-zA-Z0-9_\-]+'), flatten([list_concat(list_concat([r], [substr(r, i, 2) for i in range(1, length(r))]), [substr(r, i, 3) for i in range(1, length(r) - 1)]) for r in regexp_extract_all(s, '{_CJK}')])), '|') AS tokens
  FROM (SELECT doc_id, {_MIXED} AS s FROM documents)""")
def search_tokens(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d).select("doc_id", joined(T.search_tokens(F.col("s")), "tokens"))


@query(r"SELECT doc_id, array_to_string([lower(t) for t in regexp_extract_all(text, '[a-zA-Z0-9_\-]+')], '|') AS tokens FROM documents")
def lowercase(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", joined(T.lowercase(T.words(F.col("text"))), "tokens"))


_STOP = ", ".join(f"'{w}'" for w in [*T.STOP_WORDS, *T.STOP_PARTICLES])


@query(rf"SELECT doc_id, array_to_string([t for t in regexp_extract_all(text, '[a-zA-Z0-9_\-]+') if lower(t) NOT IN ({_STOP})], '|') AS tokens FROM documents")
def stopwords(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", joined(T.drop_stop_words(T.words(F.col("text"))), "tokens"))


@query(rf"""SELECT doc_id, array_to_string(flatten([CASE lower(t) WHEN 'ransomware' THEN [t, 'ランサムウェア'] WHEN 'malware' THEN [t, 'マルウェア'] WHEN 'attack' THEN [t, '攻撃'] WHEN 'security' THEN [t, 'セキュリティ'] WHEN 'cryptography' THEN [t, '暗号'] ELSE [t] END
  for t in regexp_extract_all(s, '[a-zA-Z0-9_\-]+')]), '|') AS tokens FROM (SELECT doc_id, {_MIXED} AS s FROM documents)""")
def synonyms(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d).select("doc_id", joined(T.with_synonyms(T.words(F.col("s"))), "tokens"))


@query(r"SELECT s_suppkey, array_to_string([substr(s_name, 1, i) for i in range(2, least(length(s_name), 6) + 1)], '|') AS grams FROM supplier")
def edge_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", joined(T.edge_grams(F.col("s_name")), "grams"))


@query(rf"""SELECT doc_id, array_to_string([t for t in list_concat(regexp_extract_all(p, '[a-zA-Z0-9_\-]+'), flatten([list_concat([r], [substr(r, i, 2) for i in range(1, length(r))]) for r in regexp_extract_all(p, '{_CJK}')])) if t NOT IN ({_STOP})], '|') AS tokens
  FROM (SELECT doc_id, lower(regexp_replace({_MIXED}, '<[^>]+>', ' ', 'g')) AS p FROM documents)""")
def analyze(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d).select("doc_id", joined(T.analyze(F.col("s")), "tokens"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_\-]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  s AS (SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM documents) / df), 6) AS weight FROM tf JOIN df USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM s)
  SELECT doc_id, term, weight, rank FROM r WHERE rank <= 3""")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    """The three terms of highest tf-idf of each document."""
    from ..operators.fulltext import tf_idf

    return tf_idf(docs(spark, d), "doc_id", "text", 3)


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 1000 THEN ((length(text) - length(replace(lower(text), 'anan', ''))) // 4)::BIGINT
  ELSE (SELECT count(*) FROM (SELECT unnest(range(1, length(text))) AS i) WHERE substr(lower(text), i, 4) = 'anan') END AS n FROM documents""")
def substr_count(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.count_substring(F.col("text"), "anan").alias("n"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.clean(F.col("text")).alias("clean"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_\-]+')) AS s FROM documents)
  SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0 ELSE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) END AS score FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each document's words against the next one's."""
    t = docs(spark, d).select("doc_id", F.array_distinct(T.words(F.lower(F.col("text")))).alias("s"))
    n = t.select(F.col("doc_id").alias("b"), F.col("s").alias("o"), (F.col("doc_id") - 1).alias("before"))
    return t.join(n, F.col("doc_id") == F.col("before")).select(F.col("doc_id").alias("a"), "b", T.jaccard(F.col("s"), F.col("o")).alias("score"))


def _sql_any(ks: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{k}')" for k in ks) + ")"


#: Documents with a phrase of each taxonomy put in by number, so that every rule is met.
PHRASES = ["llm agent", "lattice signature", "quic traffic", "malware fuzzing", "watermark leakage", "smart grid firmware", "storage", "nothing", "denial of service", "phishing", "backdoor", "privilege escalation", "remote code execution", "zero trust model"]
_TOPIC = f"(SELECT doc_id, lang, source, [{', '.join(f"'{p}'" for p in PHRASES)}][doc_id % {len(PHRASES)} + 1] || ' ' || split_part(text, chr(10), 1) AS title, text FROM documents)"
_WHOLE = f"(SELECT *, title || ' ' || text AS body FROM {_TOPIC})"


def topical(spark: SparkSession, d: str) -> DataFrame:
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES)).cast("int"))
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.concat(phrase, F.lit(" "), T.title(F.col("text"))).alias("title"), "text").withColumn("body", F.concat("title", F.lit(" "), "text"))


_DOMAIN = "CASE " + " ".join(f"WHEN {_sql_any(ks)} THEN '{n}'" for n, ks in G.DOMAINS.items()) + f" ELSE '{G.OTHER_DOMAIN}' END"


@query(f"SELECT doc_id, {_DOMAIN} AS domain FROM (SELECT doc_id, lower(body) AS t FROM {_WHOLE})")
def classify_domain(spark: SparkSession, d: str) -> DataFrame:
    return topical(spark, d).select("doc_id", G.classify_domain(F.col("body")).alias("domain"))


def _sql_labels(taxonomy: dict[str, list[str]]) -> str:
    return "[x for x in [" + ", ".join(f"CASE WHEN {_sql_any(ks)} THEN '{n}' END" for n, ks in taxonomy.items()) + "] if x IS NOT NULL]"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(['cs.CR', {_DOMAIN.replace('contains(t', 'contains(u')}], {_sql_labels(G.TAGS)}))), '|') AS tags FROM (SELECT doc_id, lower(body) AS t, lower(body) || ' cs.cr' AS u FROM {_WHOLE})")
def security_tags(spark: SparkSession, d: str) -> DataFrame:
    return topical(spark, d).select("doc_id", joined(G.security_tags(F.col("body"), F.lit(None).cast("array<string>")), "tags"))


@query(f"SELECT doc_id, array_to_string(list_sort({_sql_labels(G.TECHNIQUES)}), '|') AS techniques FROM (SELECT doc_id, lower(body) AS t FROM {_WHOLE})")
def mitre(spark: SparkSession, d: str) -> DataFrame:
    return topical(spark, d).select("doc_id", joined(G.labels(F.col("body"), G.TECHNIQUES), "techniques"))


@query(f"SELECT doc_id, array_to_string(list_sort({_sql_labels(G.STRIDE)}), '|') AS categories FROM (SELECT doc_id, lower(body) AS t FROM {_WHOLE})")
def stride(spark: SparkSession, d: str) -> DataFrame:
    return topical(spark, d).select("doc_id", joined(G.labels(F.col("body"), G.STRIDE), "categories"))


_THREATS = ", ".join("CASE WHEN regexp_matches(html, '" + p.replace("'", "''") + f"') THEN '{n}' END" for p, n in G.THREATS)


@query(f"SELECT page_id, array_to_string([x for x in [{_THREATS}] if x IS NOT NULL], '|') AS warnings FROM pages")
def threat_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", joined(G.threats(F.col("html")), "warnings"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS safe FROM pages")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("safe"))


_TERMS = ", ".join(f"'{t}'" for t in G.TOPIC_TERMS)


@query(rf"SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE least(1.0, 10.0::DOUBLE * len([x for x in w if x IN ({_TERMS})]) / len(w)) END AS score FROM (SELECT doc_id, regexp_extract_all(regexp_replace(lower(title), '[^\x00-\x7F]', ' ', 'g'), '\b[a-zA-Z_-]+\b') AS w FROM (SELECT doc_id, body || ' attack' AS title FROM {_WHOLE}))")
def topic_relevance(spark: SparkSession, d: str) -> DataFrame:
    return topical(spark, d).select("doc_id", G.topic_relevance(F.regexp_replace(F.concat("body", F.lit(" attack")), r"[^\x00-\x7F]", " ")).alias("score"))


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct([x for x in [source, CASE WHEN contains(t, 'security') OR contains(x, 'security') THEN 'security' END, CASE WHEN contains(t, 'zero trust') OR contains(x, 'zero trust') THEN 'zero-trust' END,
  CASE WHEN contains(t, 'ai') OR contains(x, 'model') THEN 'artificial-intelligence' END] if x IS NOT NULL])), '|') AS tags FROM (SELECT doc_id, source, lower(title) AS t, lower(text) AS x FROM {_TOPIC})""")
def process_record(spark: SparkSession, d: str) -> DataFrame:
    return topical(spark, d).select("doc_id", joined(G.record_tags(F.col("source"), F.col("title"), F.col("text")), "tags"))


@query("SELECT event_id, substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, 10) AS day FROM events")
def pub_date(spark: SparkSession, d: str) -> DataFrame:
    s = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "events").select("event_id", F.when(s.rlike(r"^\d{4}") & (F.length(s) >= 10), F.substring(s, 1, 10)).otherwise(F.date_format(F.current_date(), "yyyy-MM-dd")).alias("day"))


@query(r"SELECT doc_id, regexp_replace('2608.' || doc_id || CASE WHEN doc_id % 2 = 0 THEN 'v' || (doc_id % 5) ELSE '' END, 'v\d+$', '') AS clean FROM documents")
def clean_id(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("2608."), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("v"), (F.col("doc_id") % 5).cast("string"))).otherwise(""))
    return docs(spark, d).select("doc_id", F.regexp_replace(raw, r"v\d+$", "").alias("clean"))


@query()
def nfkc(spark: SparkSession, d: str) -> DataFrame:
    """Unicode compatibility composition: no built-in does it, so an Arrow batch function."""
    import unicodedata

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return mixed(spark, d).select("doc_id", compose("s").alias("normal"))


@query()
def stem(spark: SparkSession, d: str) -> DataFrame:
    """Porter stems of each distinct word, so that each is stemmed once."""
    from ..functions.porter import stem_column

    words = docs(spark, d).select(F.explode(T.words(F.lower(F.col("text")))).alias("word")).distinct()
    return words.select("word", stem_column("word").alias("stem"))


@query()
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, token, start, end): words, then CJK runs with bigrams; one row a token from a table function."""
    from ..functions.offsets import token_offsets as offsets

    return offsets(mixed(spark, d), "doc_id", "s")


@query()
def highlight(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.highlight import fragment

    return docs(spark, d).select("doc_id", fragment(F.col("text"), ["heat", "license"], centred=True, size=150).alias("snippet"))


@query()
def highlight_doc(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.highlight import fragment

    return docs(spark, d).select("doc_id", fragment(T.title(F.col("text")), ["the", "of"], centred=False, size=160).alias("title"), fragment(F.col("text"), ["heat", "license"], centred=False, size=160).alias("abstract"))


@query()
def md_tokens(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.markdown import to_html

    md = F.concat(F.lit("# "), T.title(F.col("text")), F.lit("\n\n- *one*\n- **two**\n\n`code` [x](/y)\n\n"), F.col("text"), F.lit("\n"))
    return docs(spark, d).select("doc_id", to_html(md).alias("html"))


@query()
def okf_render(spark: SparkSession, d: str) -> DataFrame:
    """Markdown records with front matter, as one string column."""
    from ..sources.records import render

    return render(topical(spark, d))


@query()
def raw_items(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.records import from_pages

    return from_pages(table(spark, d, "pages"))
