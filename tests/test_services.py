"""Hashing and Bloom bits, knowledge tables, serving, crawls, distribution, feeds, evaluation and graph cores."""

import zlib

import pytest
from pyspark.sql import functions as F

from skeinwork import orchestration as O
from skeinwork.crawling import Crawl, CrawlBuilder, CrawlState, crawl
from skeinwork.functions import hashing, knowledge, urls
from skeinwork.operators import bloom as B
from skeinwork.operators import graph, predicates, versions
from skeinwork.operators.evaluation import evaluate
from skeinwork.serving import Service
from skeinwork.sources import records

WORDS = ["", "a", "foobar", "日本", "x" * 300, "k17"]


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_fnv(spark):
    df = spark.createDataFrame([(w,) for w in [*WORDS, None]], "w string")
    got = {r["w"]: r["h"] for r in df.select("w", hashing.fnv1a(F.col("w")).alias("h")).collect()}
    assert {w: int(got[w]) for w in WORDS} == {w: fnv(w.encode()) for w in WORDS} and got[None] is None
    assert fnv(b"foobar") == 0x85944171F73967E8  # a published value


@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_bloom_bits(spark, monkeypatch, sent):
    """The bits and answers of a filter made byte by byte, sent to every task or joined by word."""
    monkeypatch.setattr(B, "SENT_BITS", sent)
    keys = [f"k{i}" for i in range(200)]
    made = B.Bloom.for_rows(200).fit(spark.createDataFrame([(k,) for k in [*keys, None]], "k string"), "k")
    assert (made.m, made.k) == (1917, 6)

    def places(key):
        h1, h2 = fnv(key.encode()), zlib.crc32(key.encode()) * 0x5BD1E995 % 2**64 or 0x9E3779B97F4A7C15
        return [(h1 + i * h2) % 2**64 % made.m for i in range(made.k)]

    bits = {p for k in keys for p in places(k)}
    held = {64 * r["word"] + b for r in made.words.collect() for b in range(64) if (r["bits"] >> b) & 1}
    assert held == bits
    probes = [f"k{i}" for i in range(900)] + [None, ""]
    got = {r["k"]: r["maybe"] for r in made.probe(spark.createDataFrame([(k,) for k in probes], "k string"), "k").collect()}
    assert got == {k: k is not None and all(p in bits for p in places(k)) for k in probes}


def test_ring(spark):
    ring = urls.Ring(["a", "b", "c"], virtual=16)
    got = spark.createDataFrame([("k1",), ("k2",), (None,)], "k string").select("k", ring.assign("k", 2).alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {"k1": ring.preference("k1", 2), "k2": ring.preference("k2", 2), None: None}


def test_knowledge(spark):
    df = spark.createDataFrame([("89",), ("cwe-22",), ("CWE-9999",), (None,)], "c string")
    got = {r["c"]: r["name"] for r in knowledge.with_recipes(df, "c").collect()}
    assert got == {"89": "SQL Injection", "cwe-22": "Path Traversal", "CWE-9999": None, None: None}
    titles = spark.createDataFrame([("Vulnerability Detection in Autonomous Vehicles",), ("Policies in Telegram Mini apps",)], "t string")
    out = [r[0] for r in titles.select(knowledge.translate_title("t")).collect()]
    assert out == ["脆弱性検出 in 自動運転車両", "Policies in Telegram Mini apps"]


def test_service(spark):
    docs = spark.createDataFrame([(1, "Ring keys\nbody of text", "en", "a"), (2, "heat", "de", "b"), (3, "ring", "en", None)], "doc_id int, text string, lang string, source string")
    s = Service(docs)
    assert {r["doc_id"] for r in s.search("ring", 5).collect()} >= {1, 3}
    assert s.paper(2)["text"] == "heat" and s.paper(9) is None and s.preview(1)["title"] == "Ring keys"
    assert [tuple(r) for r in s.trends("lang").collect()] == [("en", 2, 0.666667), ("de", 1, 0.333333)]
    assert tuple(s.stats().first()) == (3, 30, 2, 2)


def test_crawls(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.org/1", "<p>x"), ("https://sub.a.org/2", "<p>y"), ("https://b.org/3", "<p>z"), ("https://a.org/1", "<p>x"), ("https://a.org/b/c/d/e/f/g/h/i/j", "deep")], "url string, html string")
    built = CrawlBuilder("fluent").start_url("https://a.org/1").allowed_domains("a.org").with_rate_limit(0.1).with_cache().limit(5).parse_with(lambda df: df.select("url", F.upper("html").alias("title"), "wait")).build()
    assert isinstance(built, Crawl) and (built.name, built.start_urls, built.allowed_domains, built.most) == ("fluent", ("https://a.org/1",), ("a.org",), 5)
    assert sorted((r["url"], r["title"]) for r in built.run(pages).collect()) == [("https://a.org/1", "<P>X"), ("https://sub.a.org/2", "<P>Y")]

    @crawl("https://a.org/1", allowed_domains=["b.org"], min_delay=0.1, max_requests=2)
    def parse_paper(df):
        return df.select("url")

    assert isinstance(parse_paper, CrawlBuilder) and parse_paper.build().name == "parse_paper"
    assert [r["url"] for r in parse_paper.build().run(pages).collect()] == ["https://b.org/3"]

    state = CrawlState(spark, f"file://{tmp_path}/state")
    assert state.restore().count() == 0
    pending = spark.createDataFrame([("u1", 1, 5, False, {"a": "b"}), ("u2", 9, 6, False, None), ("u3", 1, 4, True, None), ("u1", 3, 7, False, None)], "url string, priority int, seq bigint, dont_filter boolean, meta map<string,string>")
    state.save(pending, pages)
    assert [(r["url"], r["priority"]) for r in state.restore().collect()] == [("u2", 9), ("u1", 3), ("u3", 1)]
    assert [r["url"] for r in state.restore(spark.createDataFrame([("u2",), ("u3",)], "url string")).collect()] == ["u1", "u3"]


def test_distribution_and_themes(spark):
    products = spark.createDataFrame([("p1", 1), ("p2", 2)], "product_id string, n int")
    d, got = O.Distributor(), []
    d.register("bad", lambda df: 1 / 0)
    d.register("good", lambda df: got.append(df.count()))
    d.disseminate(products)
    d.disseminate(spark.createDataFrame([("p3", 3)], "product_id string, n int"))
    assert got == [2, 1] and [e["channel"] for e in d.errors] == ["bad", "bad"] and d.published().count() == 3
    d.compensate(products)
    assert [r["product_id"] for r in d.published().collect()] == ["p3"]
    written = []
    sources = {"one": lambda topic, n: spark.createDataFrame([(topic, n)], "id string, n int"), "down": lambda topic, n: 1 / 0, "other": lambda topic, n: products}
    items, errors = O.run_theme(O.Theme("t", ("one", "down"), ("llm",), "out/t"), sources, lambda df: df.withColumn("x", F.lit(1)), lambda df, root: written.append((df.count(), root)), 5)
    assert [tuple(r) for r in items.collect()] == [("llm", 5, 1)] and written == [(1, "out/t")] and errors[0]["source"] == "down"
    assert O.run_theme(O.Theme("t", ("down",)), sources, None, None)[0] is None
    p = O.TopicPlanner({"a": 1.0})
    context = p.plan({}, "c1")
    assert context["directive"].quotas["a"] >= 5 and "directive" not in p.undo_plan(context)


def test_feeds(spark, tmp_path):
    atom, rss = tmp_path / "a.xml", tmp_path / "r.xml"
    atom.write_text('<feed><entry><id>http://x.org/abs/2608.1v2</id><title>T  one</title><summary>S</summary><published>2026-08-01</published><author><name>A</name></author></entry></feed>')
    rss.write_text("<rss><channel><item><title>R</title><link>http://x.org/abs/2608.7v1</link><description>D</description><pubDate>2026</pubDate></item></channel></rss>")
    first = records.read_feed(spark, f"file://{atom}", f"file://{rss}").first()
    assert (first["clean_id"], first["title"], first["source_type"], first["authors"]) == ("2608.1", "T one", "atom", ["A"])
    for empty in (f"file://{tmp_path}/none.xml",):
        item = records.read_feed(spark, empty, f"file://{rss}").first()
        assert (item["clean_id"], item["source_type"], item["pdf_url"]) == ("2608.7", "rss", "http://x.org/pdf/2608.7v1")


def test_records_out(spark, tmp_path):
    okf = '---\ntype: "paper"\ntitle: "A B"\nkeys: [x, y]\ntags:\n  - z\n---\n'
    df = spark.createDataFrame([(okf,)], "o string")
    assert [df.select(records.front_matter(F.col("o"), n)).first()[0] for n in ("title", "tags")] == ["A B", ""]
    assert df.select(F.regexp_extract("o", r"(?m)^keys:\s*\[([^\]\n]*)\]", 1)).first()[0] == "x, y"
    log = spark.createDataFrame([("q", 3, (1.5,))], "query string, hits int, performance struct<ms:double>")
    for _ in range(2):
        records.log_queries(log, f"file://{tmp_path}/log")
    assert records.read_log(spark, f"file://{tmp_path}/log").select("query", "performance.ms").collect() == [("q", 1.5)] * 2


def test_phases():
    assert [p.name for p in O.Phase] == ["PLANNING", "COLLECTION", "PROCESSING", "ANALYSIS", "DISSEMINATION", "EVALUATION"] and list(O.Phase) == sorted(O.Phase)


def test_evaluation_of_a_gold_set(spark):
    gold = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("b", 9, 2)], "query string, doc int, grade int")
    runs = {"a": [(1, 3.0), (5, 2.0), (2, 1.0)], "b": []}
    got = {r["query"]: r for r in evaluate(lambda q: spark.createDataFrame(runs[q], "doc_id int, score double"), gold, 3).collect()}
    assert got["a"]["precision"] == pytest.approx(2 / 3) and got["a"]["ap"] == pytest.approx((1 + 2 / 3) / 2) and got["b"]["recall"] == 0
    assert got["mean"]["rr"] == pytest.approx(0.5)


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_cycles_and_victims(spark, monkeypatch, few):
    """In one task, and by colours."""
    monkeypatch.setattr(graph, "FEW", few)
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 6), (7, 1), (8, 9), (9, 10)]
    got = {r["id"]: r["victim"] for r in graph.on_cycles(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5}
    named = graph.on_cycles(spark.createDataFrame([("tx_b", "tx_a"), ("tx_a", "tx_b")], "src string, dst string")).collect()
    assert {tuple(r) for r in named} == {("tx_a", "tx_b"), ("tx_b", "tx_b")}
    assert graph.on_cycles(spark.createDataFrame([(1, 2), (2, 2)], "src int, dst int")).count() == 0


def test_callbacks_and_mergers(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "yy")], "k int, s string"), spark.createDataFrame([(1, 3), (2, 2), (2, 9)], "k int, n int")
    assert [tuple(r) for r in predicates.join_where(a, b, ["k"], lambda r: len(r["s"]) == r["n"]).collect()] == [(2, "yy", 2)]
    siblings = spark.createDataFrame([("k", "b"), ("k", "a"), ("l", "c")], "key string, value string")
    assert {tuple(r) for r in versions.merge_siblings(siblings, "+".join, "string").collect()} == {("k", "a+b"), ("l", "c")}
