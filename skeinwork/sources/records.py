"""Paper records: from crawled pages, Atom and RSS feeds, and out to Markdown with front matter or JSON by date."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tagging, text

ITEM = "id string, clean_id string, title string, abstract string, authors array<string>, published string, updated string, url string, pdf_url string, category string, categories array<string>, source_type string, extra map<string,string>"


def clean_id(raw):
    """An id without its version suffix."""
    return F.regexp_replace(raw, r"v\d+$", "")


def from_pages(pages: DataFrame) -> DataFrame:
    """Scraped pages as records."""
    title = F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    body = text.clean(text.strip_html(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")))
    blank = F.lit(None).cast("string")
    return pages.select(
        F.col("page_id").cast("string").alias("id"), clean_id(F.col("page_id").cast("string")).alias("clean_id"), title.alias("title"), body.alias("abstract"), F.array().cast("array<string>").alias("authors"),
        blank.alias("published"), blank.alias("updated"), "url", blank.alias("pdf_url"), F.lit("web").alias("category"), F.array(F.lit("web")).alias("categories"), F.lit("spider").alias("source_type"), F.create_map(F.lit("host"), F.parse_url("url", F.lit("HOST"))).alias("extra"),
    )


ENTRY = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, link array<struct<_href:string,_title:string,_rel:string>>, category array<struct<_term:string>>"


def parse_atom(entries: DataFrame, xml: str = "xml") -> DataFrame:
    """Atom entries (one XML string each) as records; the id is the last part of the entry's id."""
    e = entries.select(F.from_xml(xml, ENTRY).alias("e"))
    raw = F.element_at(F.split("e.id", "/"), -1)
    pdf = F.get(F.filter("e.link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    terms = F.transform("e.category", lambda c: c["_term"])
    return e.select(
        raw.alias("id"), clean_id(raw).alias("clean_id"), text.clean(F.col("e.title")).alias("title"), text.clean(F.col("e.summary")).alias("abstract"), F.transform("e.author", lambda a: a["name"]).alias("authors"),
        F.col("e.published").alias("published"), F.col("e.updated").alias("updated"), F.col("e.id").alias("url"), F.coalesce(pdf, F.replace("e.id", F.lit("/abs/"), F.lit("/pdf/"))).alias("pdf_url"),
        F.get(terms, F.lit(0)).alias("category"), terms.alias("categories"), F.lit("atom").alias("source_type"), F.create_map().cast("map<string,string>").alias("extra"),
    )


def parse_advisories(items: DataFrame, xml: str = "xml") -> DataFrame:
    """RSS items: CVE ids, or dddd/ddd paper ids from the link."""
    i = items.select(F.from_xml(xml, "title string, link string, description string, pubDate string").alias("i"))
    both = F.concat_ws(" ", "i.title", "i.description")
    return i.select(F.col("i.title").alias("title"), F.col("i.link").alias("url"), F.regexp_extract_all(both, F.lit(r"CVE-\d{4}-\d{4,7}"), F.lit(0)).alias("cves"), F.nullif(F.regexp_extract("i.link", r"(\d{4}/\d{3,4})", 1), F.lit("")).alias("paper"))


def render(df: DataFrame) -> DataFrame:
    """(doc_id, okf) of (doc_id, title, text, source): front matter, then the text."""
    tags = tagging.security_tags(F.concat_ws(" ", "title", "text"), F.lit(None).cast("array<string>"))
    quoted = F.replace("title", F.lit('"'), F.lit("'"))
    head = F.format_string('---\ntype: "paper"\ntitle: "%s"\nresource: "urn:doc:%s"\ntags:\n%s\nprovenance:\n  origin: "%s"\n---\n\n# %s\n\n%s\n', quoted, F.col("doc_id").cast("string"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit('  - "'), t, F.lit('"'))), "\n"), F.coalesce("source", F.lit("")), F.col("title"), F.coalesce("text", F.lit("")))
    return df.select("doc_id", head.alias("okf"))


def write_okf(df: DataFrame, path: str) -> None:
    """One text record a row; the committer renames whole files into place."""
    render(df).select("okf").write.option("lineSep", "\x1e").mode("append").text(path)


def write_by_date(items: DataFrame, path: str) -> None:
    """Raw records as JSON in a folder for each day published."""
    day = F.when(F.col("published").rlike(r"^\d{4}") & (F.length("published") >= 10), F.substring("published", 1, 10)).otherwise(F.date_format(F.current_date(), "yyyy-MM-dd"))
    items.withColumn("day", day).write.partitionBy("day").mode("append").json(path)


def abstract_of(okf):
    """The quoted block below ### Abstract, else all quoted lines, else empty."""
    block = F.regexp_extract(okf, r"(?is)###\s*Abstract\s*\n+((?:>[^\n]*\n?)+)", 1)
    lines = F.filter(F.split(F.when(block != "", block).otherwise(okf), "\n"), lambda x: x.startswith(">"))
    return F.trim(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^>\s?", "")), " "))


def front_matter(okf, name: str):
    """A scalar of the front matter, or an inline list's inside."""
    return F.regexp_extract(okf, rf'(?m)^{name}:\s*(?:"([^"\n]*)"|\[([^\]\n]*)\])\s*$', 1)


def read_feed(spark: SparkSession, atom: str, rss: str | None = None, limit: int = 100) -> DataFrame:
    """Records of an Atom feed (a path that Spark reads), or of an RSS feed if that has none or can't be read; at most ``limit`` of them, by id."""
    try:
        entries = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(atom).select(F.to_xml(F.struct("*"), {"rowTag": "entry"}).alias("xml"))
        items = parse_atom(entries).filter("id is not null")
        if items.limit(1).collect():
            return items.orderBy("id").limit(limit)
    except AnalysisException:  # no such feed
        if rss is None:
            raise
    if rss is None:
        return spark.createDataFrame([], ITEM)
    item = "title string, link string, description string, pubDate string, guid string"
    i = spark.read.format("xml").option("rowTag", "item").schema(item).load(rss)
    blank, raw = F.lit(None).cast("string"), F.element_at(F.split("link", "/"), -1)
    return i.select(
        raw.alias("id"), clean_id(raw).alias("clean_id"), text.clean(F.col("title")).alias("title"), text.clean(F.col("description")).alias("abstract"), F.array().cast("array<string>").alias("authors"),
        F.col("pubDate").alias("published"), blank.alias("updated"), F.col("link").alias("url"), F.replace("link", F.lit("/abs/"), F.lit("/pdf/")).alias("pdf_url"), blank.alias("category"), F.array().cast("array<string>").alias("categories"), F.lit("rss").alias("source_type"), F.create_map().cast("map<string,string>").alias("extra"),
    ).orderBy("id").limit(min(limit, 50))


class Registry:
    """Named record sources: functions (spark, options) -> DataFrame."""

    def __init__(self) -> None:
        self._sources: dict = {}

    def register(self, name: str, read) -> None:
        self._sources[name] = read

    def get(self, name: str):
        if name not in self._sources:
            raise KeyError(f"no source {name}; have {self.names()}")
        return self._sources[name]

    def names(self) -> list[str]:
        return sorted(self._sources)


def log_queries(rows: DataFrame, path: str) -> None:
    """Append query log lines as JSON, the performance fields as a nested object."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
