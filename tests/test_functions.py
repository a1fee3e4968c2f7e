"""Pinned values and edge cases of column functions and operators."""

import math

import pytest
from conftest import SF
from pyspark.sql import functions as F

from skeinwork.functions import tagging, text, urls
from skeinwork.functions.css import select_texts
from skeinwork.functions.highlight import fragment
from skeinwork.functions.markdown import compile_markdown
from skeinwork.functions.porter import stem
from skeinwork.operators import contracts, fulltext, graph, stats, vectors, versions
from skeinwork.operators.bloom import Bloom
from skeinwork.operators.evaluation import ranked_measures
from skeinwork.operators.facets import faceted_filter
from skeinwork.operators.index import SearchIndex, postings
from skeinwork.operators.pipeline import parse, retrieve, search, select
from skeinwork.plans.planning import phi_of
from skeinwork.sources import records
from skeinwork.sources.ranks import global_rank


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("out")).first()["out"]


def test_text_analysis(spark):
    assert one(spark, text.clean(F.col("s")), s="  Hello \n\t World  ") == "Hello World"
    assert one(spark, text.clean(F.col("s").cast("string")), s=None) == ""
    assert "2608.12345" in one(spark, text.all_matches(F.col("s"), text.DOTTED_WORD), s="arXiv:2608.12345 Ransomware Attack")
    assert one(spark, text.cjk_tokens(F.col("s"), 2), s="脆弱性診断") == ["脆弱性診断", "脆弱", "弱性", "性診", "診断"]
    assert "ランサムウェア" in one(spark, text.with_synonyms(F.array(F.col("s"))), s="ransomware")
    assert one(spark, text.analyze(F.col("s")), s="<p>The Security</p>") == ["security"]
    assert one(spark, text.map_chars(F.col("s"), {"foo": "bar"}), s="foo test") == "bar test"
    assert one(spark, text.count_substring(F.col("s"), "aa"), s="aaaa") == 2
    assert one(spark, text.count_substring(F.col("s"), "aa"), s="aaaa" + "x" * 1000) == 3


def test_stems():
    assert [stem(w) for w in ("vulnerabilities", "attacks", "protecting", "agreed", "hopping", "sky", "a", "")] == ["vulnerabiliti", "attack", "protect", "agree", "hop", "sky", "a", ""]


def test_highlight_and_markdown(spark):
    assert one(spark, fragment(F.col("s"), ["ring"], True, 150), s="a <ring> b") == "a &lt;<em>ring</em>&gt; b"
    assert one(spark, fragment(F.col("s"), ["zzz"], False, 5), s="abcdefgh") == "abcde..."
    assert compile_markdown("# A *b*\n\n- x\n- `y`\n") == "<h1>A <em>b</em></h1>\n<ul><li>x</li><li><code>y</code></li></ul>"


def test_tagging(spark):
    assert one(spark, tagging.classify_domain(F.col("s")), s="Storage") == "AI/ML Security"  # rag is a part of it
    assert one(spark, tagging.classify_domain(F.col("s")), s="quiet") == tagging.OTHER_DOMAIN
    assert one(spark, tagging.threats(F.col("s")), s="<script>x</script> rm -rf /") == ["COMMAND_INJECTION: Dangerous Shell Command", "XSS: Script Tag XSS"]
    assert one(spark, tagging.labels(F.col("s"), tagging.STRIDE), s="spoofing and DDoS") == ["Denial of Service", "Spoofing"]


def test_urls(spark):
    assert urls.normal_url("HTTP://Ex.com:80/a/../b/?utm_source=x&z=1&a=2#f") == "http://ex.com/b/?a=2&z=1"
    assert urls.normal_url("https://ex.com") == "https://ex.com/"
    assert one(spark, urls.is_trap(F.col("s")), s="https://x.org/authors/a") and not one(spark, urls.is_trap(F.col("s")), s="https://x.org/a/b")
    assert select_texts("<div class='a b'><p>x<b>y</b></p></div><p>z</p>", "div.a p") == ["xy"]
    counts = {n: 0 for n in ("a", "b", "c")}
    ring = urls.Ring(list(counts))
    for i in range(1200):
        counts[ring.node(f"k{i}")] += 1
    assert all(280 <= c <= 520 for c in counts.values())
    assert len(set(ring.preference("k", 5))) == 3


def test_vectors(spark):
    assert one(spark, vectors.cosine_sim("a", "b"), a=[1.0, 0.0], b=[1.0]) == 0.0
    e = vectors.embed("Ransomware attack")
    assert math.isclose(sum(x * x for x in e), 1.0) and vectors.embed("") == [0.0] * 128
    lists = [spark.createDataFrame(rows, "id string, score double") for rows in ([("a", 9.0), ("b", 8.0)], [("b", 0.9), ("c", 0.8)])]
    got = {r["id"]: r["rrf_score"] for r in vectors.rrf(*lists, "id").collect()}
    assert got == {"a": round(0.5 / 61, 6), "b": round(0.5 / 62 + 0.5 / 61, 6), "c": round(0.5 / 62, 6)}


def test_bm25_and_parser(spark):
    docs = spark.createDataFrame([(0, "Ransomware attack on networks", "en"), (1, "quantum lattice attack", "de"), (2, None, "en")], "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in fulltext.bm25(docs, "doc_id", {"text": 1.0}, ["attack"]).collect()} == {0, 1}
    q = parse('+a -b "c d"~2 x* y~1 f^4.0 author:z')
    assert (q.must, q.banned, q.phrases, q.prefixes, q.fuzzy, q.terms["f"], q.fields) == (["a"], ["b"], [(["c", "d"], 2)], ["x"], [("y", 1)], 4.0, [("author", "z")])
    assert select(docs, {"q": "attack", "fq": "lang = 'de'"}).first()["num_found"] == 1
    assert search(docs.filter("text is not null"), None, "attack", 2).count() == 2
    own = docs.filter("text is not null").select("doc_id", vectors.embed_column("text").alias("vector")).filter("doc_id = 1")
    assert [r["vector_rank"] for r in search(docs.filter("text is not null"), own, "nothing", 2).collect()] == [1]
    posts = {(r["term"], r["key"]): r["positions"] for r in postings(docs, "doc_id", {"text": "text"}).collect()}
    assert posts["attack", 0] == [1]


def test_query_tree(spark):
    docs = spark.createDataFrame([(1, "ring attack on keys"), (2, "lattice keys"), (3, "ring signature"), (4, "攻撃 report"), (5, None)], "doc_id int, text string")
    hits = lambda q: {r["doc_id"] for r in retrieve(docs, parse(q), "doc_id", "text").collect()}
    assert hits("ring AND keys") == {1} and hits("(ring OR lattice) AND keys") == {1, 2} and hits("ring AND NOT keys") == {3}
    assert hits("lattice OR ring AND signature") == {2, 3} and hits('(ring OR lattice) AND "attack on"') == {1} and hits("keys AND (latt* OR sig*)") == {2}
    assert hits("attack") == {1, 4} and hits("+attack") == {1, 4}  # by its synonym as well
    scores = {r["doc_id"]: r["score"] for r in retrieve(docs, parse("attack"), "doc_id", "text").collect()}
    assert 0 < scores[4] and parse("a AND NOT b").terms == {"a": 1.0}
    for bad in ("(a", "a)", "a AND", "AND a", "NOT"):
        with pytest.raises(ValueError):
            parse(bad)


def test_phrases(spark):
    held = lambda s, words, slop: one(spark, fulltext.has_phrase(F.split(F.col("s"), " "), words, slop), s=s)
    assert held("a b c", ["a", "b"], 0) and not held("a x b", ["a", "b"], 0) and held("a x b", ["a", "b"], 1) and not held("b a", ["a", "b"], 3)
    assert held("a a b", ["a", "a", "b"], 0) and not held("a b", ["a", "a", "b"], 2) and held("a b x a b c", ["a", "b", "c"], 0) and not held("", ["a"], 0)


def test_stored_index(spark, tmp_path):
    """Scores as without an index; adds, deletes and merges change what is found."""
    texts = ["ring attack", "lattice ring ring", "heat", None, "a ring of keys"]
    docs = spark.createDataFrame([(i, t, f"title {i} ring" if i % 2 else "plain") for i, t in enumerate(texts)], "id int, body string, head string")
    made = SearchIndex.build(docs, f"file://{tmp_path}/i", "id", {"body": "body", "head": "head"})
    want = {r["id"]: round(r["score"], 9) for r in fulltext.bm25(docs, "id", {"body": 1.0, "head": 4.0}, ["ring", "keys"]).collect()}
    found = lambda ix: {r["id"]: round(r["score"], 9) for r in ix.search({"ring": 1.0, "keys": 1.0}, {"body": 1.0, "head": 4.0}).collect()}
    assert found(made) == want
    assert {r["id"] for r in made.phrase(["ring", "ring"]).collect()} == {1} and {r["id"] for r in made.phrase(["a", "keys"], 2).collect()} == {4}
    made.delete(docs.filter("id = 1").select("id"))
    assert 1 not in found(made) and made.status()["live"] == 4 and made.status()["deleted"] == 1
    made.add(spark.createDataFrame([(4, "nothing", "plain"), (1, "ring", "x")], "id int, body string, head string"))
    now = docs.filter("id not in (1, 4)").unionByName(spark.createDataFrame([(4, "nothing", "plain"), (1, "ring", "x")], "id int, body string, head string"))
    want = {r["id"]: round(r["score"], 9) for r in fulltext.bm25(now, "id", {"body": 1.0, "head": 4.0}, ["ring", "keys"]).collect()}
    assert found(made) == want == found(made.merge(f"file://{tmp_path}/j"))


def test_ranks_of_many_rows_with_a_carried_column(spark):
    """More rows than the sample of a range partitioning holds, with a column that only one branch needs."""
    rows = spark.range(600_000).select((F.col("id") * 7919 % 600_000 % 1000).alias("k"), "id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    placed = global_rank(rows, ["k", "id"], "place", "n").agg(F.countDistinct("place").alias("d"), F.min("place").alias("a"), F.max("place").alias("b"), F.max("n").alias("n")).first()
    assert tuple(placed) == (600_000, 1, 600_000, 600_000)


def test_running_values_across_partitions(spark):
    """One group that lies in all partitions, small ones, and one of null: as by a window over whole groups."""
    from pyspark.sql import Window

    from skeinwork.sources.ranks import running

    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, (F.col("id") % 37).cast("string")).alias("g"), (F.col("id") * 7919 % 5003).alias("o"), (F.col("id") % 5).alias("x"))
    w = Window.partitionBy("g").orderBy("o")
    want = rows.select("g", "o", F.row_number().over(w).alias("r"), F.sum("x").over(w).alias("s"), F.lag("o").over(w).alias("l"))
    got = running(rows, "g", ["o"], rank="r", sums={"x": "s"}, lags={"o": "l"}).select("g", "o", "r", "s", "l")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_merkle_of_many_levels(spark):
    """One shuffle for ten levels gives the root of pairing level by level, whatever the number of leaves."""
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for n in (1, 2, 5, 1024, 1025, 3001):
        level = [h(f"{i:05}:v{i}") for i in range(n)]
        while len(level) > 1:
            level = [h(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        leaves = spark.range(n).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("key"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
        assert versions.merkle_root(leaves).first()["root"] == level[0], n


def test_cells_find_nine_of_ten(spark):
    """Recall over all queries of the test data against brute force, and tables without vectors."""
    import numpy as np

    e = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    rows = e.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.CellIndex(e)
    got = {}
    for r in index.search_many(e.filter("vec_id % 50 = 0").select("vec_id", "embedding"), 10).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    hits = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        hits += len(got[q] & set(ids[np.lexsort((ids, -np.round(s, 6)))[:10]].tolist()))
    recall = hits / (10 * len(ids[ids % 50 == 0]))
    print("recall", recall, "probes", index.probes, "of", len(index.centres))
    assert recall >= 0.9
    assert vectors.CellIndex(e.filter("false")).search_many(e.select("vec_id", "embedding"), 3).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([
        ("p1", {"quantum": 10, "cryptography": 8, "key": 5}, ["quantum", "post-quantum", "crypto"], ["cryptography"]),
        ("p2", {"quantum": 8, "key": 6, "exchange": 4}, ["quantum", "key-exchange"], ["cryptography"]),
        ("p3", {"web": 12, "waf": 9, "xss": 7}, ["waf", "web-security"], ["web-security"]), ("p4", None, None, None),
    ], "id string, token_counts map<string,int>, annotated_keywords array<string>, tags array<string>")
    got = vectors.proximity_graph(docs, 2).collect()
    assert {(r["src"], r["dst"]) for r in got} == {("p1", "p2"), ("p2", "p1")} and all(r["similarity"] > 0.3 for r in got)


def test_facets(spark):
    df = spark.createDataFrame([("2026", "cs.CR", ["x"], "d"), ("2025", "quant-ph", ["y"], "d")], "year string, category string, tags array<string>, domain string")
    assert faceted_filter(df, year="1900").count() == 2
    assert faceted_filter(df, category="none").count() == 0
    assert faceted_filter(df, year="2026", tag=" X ").count() == 1
    got = {r["bucket"]: r["n"] for r in fulltext.range_facet(spark.createDataFrame([("2026",), ("2027",), ("2025",), ("x",)], "y string"), "y", 2025, 2027, 1).collect()}
    assert got == {"[2025 TO 2026]": 1, "[2026 TO 2027]": 2}


def test_statistics(spark):
    values = spark.createDataFrame([(i if i % 7 else None,) for i in range(24)], "v int")
    got = sorted((r["bucket"], r["n"]) for r in stats.equi_depth(values, "v", 10).collect())
    assert [n for _, n in got] == [2] * 10
    assert sorted(r["i"] for r in global_rank(values, ["v"], "i", "n").collect()) == list(range(1, 25))
    bloom = Bloom.for_rows(300).fit(spark.range(300).select(F.col("id").cast("string").alias("k")), "k")
    keys = spark.range(2300).select("id", F.col("id").cast("string").alias("k"))
    probe = bloom.probe(keys, "k", "m")
    assert probe.filter("id < 300 and not m").count() == 0 and probe.filter("id >= 300 and m").count() < 60
    assert phi_of(-3) == pytest.approx(0, abs=1e-4) and phi_of(6) == 16.0 and phi_of(20) > 12


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src bigint, dst bigint")
    assert sorted(r["id"] for r in graph.on_cycles(edges).collect()) == [1, 2, 3]
    assert {(r["id"], r["hops"]) for r in graph.within_hops(edges, spark.createDataFrame([(1,)], "id bigint")).collect()} == {(1, 0), (2, 1), (3, 2)}
    nodes = spark.createDataFrame([(i,) for i in range(1, 5)], "id bigint")
    assert {r["rank"] for r in graph.pagerank(nodes, edges.filter("false")).collect()} == {0.25}
    cash = spark.createDataFrame([("hub", 1.0, 0.0)], "url string, cash double, history double")
    links = spark.createDataFrame([("hub", "p1"), ("hub", "p2")], "url string, target string")
    assert {r["url"]: r["cash"] for r in graph.opic_round(cash, links).collect()} == {"hub": 0.0, "p1": 1.5, "p2": 1.5}


def test_clocks_and_merkle(spark):
    df = spark.sql("select map('a', 1, 'b', 2) x, map('a', 2, 'c', 0) y")
    assert df.select(versions.clock_merge("x", "y").alias("m")).first()["m"] == {"a": 2, "b": 2}
    assert df.select(versions.clock_relation("x", "y").alias("r")).first()["r"] == "concurrent"
    leaves = spark.createDataFrame([("k1", "v"), ("k2", "v"), ("k3", "v")], "key string, value string")
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    a, b, c = (h(f"k{i}:v") for i in (1, 2, 3))
    assert versions.merkle_root(leaves).first()["root"] == h(h(a + b) + h(c + c))
    assert versions.merkle_root(leaves.filter("false")).first()["leaves"] == 0


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q", 1, 3), ("q", 2, 0), ("q", 3, 1)], "query string, rank int, rel int")
    r = ranked_measures(ranked, ranked.select("query", "rel"), 2).first()
    assert (r["precision"], r["recall"], r["rr"]) == (0.5, 0.5, 1.0)
    assert r["ap"] == pytest.approx((1 + 2 / 3) / 2) and r["ndcg"] == pytest.approx(7 / (7 + 1 / math.log2(3)))


def test_records(spark, tmp_path):
    entry = '<entry><id>http://arxiv.org/abs/2608.12345v1</id><title>Deep  Learning</title><summary>s</summary><published>2026-08-01T00:00:00Z</published><author><name>Alice Smith</name></author><author><name>Bob Jones</name></author><category term="cs.CR"/></entry>'
    r = records.parse_atom(spark.createDataFrame([(entry,)], "xml string")).first()
    assert (r["id"], r["clean_id"], r["title"], r["authors"]) == ("2608.12345v1", "2608.12345", "Deep Learning", ["Alice Smith", "Bob Jones"])
    item = "<item><title>CVE-2026-12345 bug</title><link>https://eprint/2026/123</link><description>x</description></item>"
    a = records.parse_advisories(spark.createDataFrame([(item,)], "xml string")).first()
    assert a["cves"] == ["CVE-2026-12345"] and a["paper"] == "2026/123"
    records.write_by_date(records.parse_atom(spark.createDataFrame([(entry,)], "xml string")), str(tmp_path / "raw"))
    assert (tmp_path / "raw" / "day=2026-08-01").is_dir()
    okf = '---\ntitle: "T"\ntags: [a, b]\n---\n### Abstract\n\n> one\n> two\n'
    assert one(spark, records.abstract_of(F.col("s")), s=okf) == "one two"
    reg = records.Registry()
    reg.register("x", lambda s, o: None)
    assert reg.names() == ["x"]
    with pytest.raises(KeyError):
        reg.get("y")


def test_contracts(spark):
    items = spark.createDataFrame([("u", "h"), (None, "h")], "url string, html string")
    assert not contracts.verify(items, ["url"]) and contracts.verify(items.filter("url is not null"), ["url"]) and not contracts.verify(items.filter("false"), ["url"])
    assert contracts.directives("x\n@url http://a\n@returns items 1") == {"url": ["http://a"], "returns": ["items", "1"]}
