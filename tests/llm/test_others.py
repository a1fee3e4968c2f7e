"""Top-k search, vector near-duplicates, chat collapse and page extraction."""

import os

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from skeinwork.llm import op4_impact_topk, op6_chat
from skeinwork.llm.components import connected_components
from skeinwork.llm.html_blocks import Block, leaf_blocks
from skeinwork.llm.html_crf import trained
from skeinwork.llm.html_samples import MARK, sample_pages
from skeinwork.llm.op4_impact_topk import top_k
from skeinwork.llm.op6_chat import maximal_conversations, render_chats
from skeinwork.llm.op8_e8_lattice import e8_points, near_vectors
from skeinwork.llm.op10_html import extract_text, main_text


def test_top_k_agrees_with_sql(spark, same_rows):
    same_rows(top_k(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("id") % 20 == 0), op4_impact_topk.ORACLE_SQL)


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [0.25]), (5, [0.25]), (None, [1.0, 1.0]), (6, [-3.0, 1e6]), (7, [1e9, 1.0]), (8, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as score")
    got = [tuple(r) for r in top_k(df, F.col("id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    huge = 64 * -192 + 32 * 64_000_000
    assert got == [(0, 1, 6, huge), (0, 2, 20, 64 * 64 + 32 * 32), (0, 3, 4, 64 * 16), (20, 1, 6, huge), (20, 2, 0, 64 * 64 + 32 * 32), (20, 3, 4, 64 * 16)]
    assert top_k(df.filter("false"), F.col("id") % 20 == 0).count() == 0


def test_top_k_stops_on_proof_and_misses_nothing(spark, monkeypatch):
    """Clustered vectors in many small blocks: whole segments are skipped, and ties, repeats and the rest are as by brute force."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 32))
    x = np.round(np.concatenate([c + 0.1 * rng.normal(size=(100, 32)) for c in centres]), 2)
    x[:30] = x[0]
    monkeypatch.setattr(op4_impact_topk, "ROWS_A_PIVOT", 60)
    monkeypatch.setattr(op4_impact_topk, "ROW_BLOCK", 70)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in top_k(df, F.col("id") % 20 == 0, k=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    v = np.floor(64 * x).astype(np.int64)
    for q in range(0, len(x), 20):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:7]
        assert [got[q][r] for r in range(1, 8)] == [(i, s[i]) for i in order]
    block = op4_impact_topk.Block(np.arange(1200), v.astype(np.int32), v.mean(axis=0), np.inf)
    for part in op4_impact_topk.segments(v.astype(np.int32)):
        block.add(*part)
    found = {i: (set(rows.tolist()), exact) for i, rows, exact in block.search(np.arange(0, 1200, 20), v[::20].astype(np.int32), np.full(60, op4_impact_topk.LOWEST), 7)}
    assert len(found) == 60 and block.skipped > 0.3 * block.seen
    far = op4_impact_topk.Block(np.arange(100), v[:100].astype(np.int32), v[:100].mean(axis=0), 1.0)
    far.add(*op4_impact_topk.segments(v[:100].astype(np.int32))[0])
    assert not list(far.search(np.array([900]), -v[:1].astype(np.int32), np.array([0]), 7)) and far.skipped == far.seen


def test_e8_decoding():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    near, other, gap = e8_points(x)
    assert ((near % 2 == near[:, :1] % 2).all(axis=1)).all() and (near.sum(axis=1) % 4 == 0).all() and (gap >= 0).all()
    steps = np.array([v for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1) for v in [np.eye(8)[i] * a + np.eye(8)[j] * b]])
    d = ((x - near / 2) ** 2).sum(axis=1)
    for s in steps:  # no neighbouring lattice point is nearer
        assert (((x - near / 2 - s) ** 2).sum(axis=1) >= d - 1e-9).all()
    assert (((x - other / 2) ** 2).sum(axis=1) >= d - 1e-9).all()


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [*x, *(x[:40] + 0.03 * rng.normal(size=(40, 64))), *[x[0]] * 3, *(x[1] + 0.02 * rng.normal(size=(60, 64)))]
    v = np.array(rows, np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in r], 1) for i, r in enumerate(v)] + [(900, None, 1), (901, [0.0] * 64, 1), (902, [1.0, None], 1), (903, [float("inf")] * 64, 1), (904, [1.0], 1)], "vec_id bigint, embedding array<float>, n_links int")
    w = v.astype(np.float64)
    n = np.linalg.norm(w, axis=1)
    near = (w @ w.T) / (n[:, None] * n) >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert len(got) == len(v) + 5
    assert [got[i]["n_links"] for i in range(len(v))] == near.sum(axis=1).tolist()
    label = np.arange(len(v))
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=len(v))) for i in range(len(v))])
        if (new == label).all():
            break
        label = new
    assert [got[i]["component_id"] for i in range(len(v))] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 905))
    assert near_vectors(df.filter("false")).count() == 0


def test_near_vectors_in_small_blocks(spark, monkeypatch):
    """Cells of more than one block give what one block gives."""
    from skeinwork.llm import op8_e8_lattice as L

    rng = np.random.default_rng(7)
    base = rng.normal(size=64)
    df = spark.createDataFrame([(i, [float(c) for c in base + 0.05 * rng.normal(size=64)]) for i in range(50)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(L, "BLOCK_ROWS", 7)
    got = near_vectors(df).collect()
    assert {r["n_links"] for r in got} == {49} and {r["component_id"] for r in got} == {0}


def test_tiny_and_huge_vectors(spark):
    """Norms that vanish or overflow in double precision change no cosine."""
    rng = np.random.default_rng(3)
    rows = []
    for scale in (1e-200, 1.0, 1e200):
        for _ in range(4):
            v = rng.normal(size=16)
            rows += [v * scale, (v + 0.02 * rng.normal(size=16)) * scale]
    x = np.array(rows)
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    assert [got[i] for i in range(len(x))] == (near.sum(axis=1) - 1).tolist() and sum(got.values()) >= 24


def test_vectors_that_share_an_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (0, [1.0, 0.01]), (None, [1.0, 0.0])], "vec_id int, embedding array<float>")
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(df).collect())
    assert got == [(-1, 0, None), (0, 1, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1)]


def test_components(spark, monkeypatch):
    from skeinwork.llm import components


    path = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    want = {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}
    assert got == want
    monkeypatch.setattr(components, "FEW", 0)  # by star contraction
    for hubs in (components.HUBS, 2):
        monkeypatch.setattr(components, "HUBS", hubs)
        edges = path + [(200, i) for i in range(201, 240)]
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        assert got == {**want, **dict.fromkeys(range(200, 240), 200)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_chats_agree_with_sql(spark, same_rows):
    same_rows(render_chats(spark.read.parquet(f"{SF}/conversations.parquet")), op6_chat.ORACLE_SQL)


def test_chat_collapse(spark, duck):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), (None, None)]
    rows = [(c, t, *talk[t]) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, "user", None), (8, 0, "user", ""), (9, 2, "user", "z"), (9, 0, "user", "a"), (None, 0, "user", "lost"), (10, 0, "user", "dup"), (10, 0, "user", "dup")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as chat")
    assert sorted(r["conv_id"] for r in maximal_conversations(df).collect()) == [3, 6, 7, 8, 9, 10]
    got = {r["conv_id"]: r for r in render_chats(df).collect()}
    assert got[9]["chat"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>user\nz<|im_end|>\n" and got[10]["n_turns"] == 2
    assert render_chats(df.filter("false")).count() == 0


def test_long_conversations(spark, monkeypatch):
    """Spans of four turns give what one span gives; a conversation of 100,000 turns is one row."""
    rng = np.random.default_rng(2)
    turns = [("user", f"t{i}") for i in rng.integers(0, 3, 40)]
    rows = [(c, t, *turns[t]) for c, n in enumerate((3, 4, 5, 8, 9, 17, 40)) for t in range(n)]
    rows += [(20, t, *(turns[t] if t != 6 else ("user", "other"))) for t in range(9)] + [(21, t, *turns[t]) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert sorted(r["conv_id"] for r in maximal_conversations(df).collect()) == [6, 20]
    monkeypatch.setattr(op6_chat, "SPAN", 4)
    assert sorted(r["conv_id"] for r in maximal_conversations(df).collect()) == [6, 20]
    monkeypatch.undo()
    long = spark.range(100_000).selectExpr("id % 2 as conv_id", "id as turn", "'user' as role", "cast(id div 2 as string) as text").unionByName(df.withColumn("conv_id", F.col("conv_id") + 100))
    got = {r["conv_id"]: r["n_turns"] for r in render_chats(long).collect()}
    assert got == {0: 50_000, 106: 40, 120: 9}
    text = "word " * 400_000
    assert render_chats(spark.createDataFrame([(1, 0, "user", text)], "conv_id bigint, turn bigint, role string, text string")).first()["chat"] == f"<|im_start|>user\n{text}<|im_end|>\n"


def test_pages_held_out_accuracy():
    model = trained()
    wrong = total = 0
    for page in sample_pages(120, 77):
        blocks = leaf_blocks(page)
        gold = [int(MARK in b.text) for b in blocks]
        got = model.decode([Block(b.text.replace(MARK, ""), b.context, b.linked) for b in blocks])
        wrong += sum(a != b for a, b in zip(gold, got, strict=True))
        total += len(gold)
    assert total > 1500 and wrong / total < 0.01


def test_page_text():
    page = '<html><body><nav><a href=/>Home</a></nav><div class="cookie">We use cookies</div><article><h1>A &amp; B</h1><p>One\n  <b>two</b> &lt;x&gt;<br>three.<p>Of.</p><div class="ad">Buy now.</div><aside><p>Related things here.</p></aside></article><div id="comments"><p>Nice, really.</p></div><footer>&copy; x</footer></body></html>'
    assert main_text(page, trained()) == "A & B\n\nOne two <x> three.\n\nOf."


@pytest.mark.parametrize("page", ["<div class=x>a" * 70_000, "<div class=c%d>a" * 1, "<b>x" * 250_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<p>x</div>" * 100_000, "<a href='x" * 100_000, '<a "' * 250_000 + '>"', "<!-- " * 200_000, "<" * 1_000_000, "<table><tr><td>x" * 60_000])
def test_pages_of_a_megabyte_take_no_time(page):
    import time

    page = "".join(page % i for i in range(60_000)) if "%d" in page else page
    model = trained()
    began = time.perf_counter()
    main_text(page, model)
    assert time.perf_counter() - began < 40  # a tenth of that on an idle core; quadratic work took minutes


def test_article_blocks_of_the_test_data():
    """Pages of the test data mark their articles by their structure: all of its paragraphs and headings, and nothing else, is main text."""
    import re

    import pyarrow.parquet as pq

    right = total = exact = 0
    rows = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    for row in rows:
        page = row["html"]
        inner = re.search(r"(?is)<(article|main)\b[^>]*>(.*)</\1>", page)
        if not inner:
            continue
        blocks = leaf_blocks(page)
        got = trained().decode(blocks)
        inside = {b.text for b in leaf_blocks(inner[2])}
        for b, label in zip(blocks, got, strict=True):
            if label:
                total += 1
                right += b.text in inside
        exact += 1
    assert exact >= 5 and right / total > 0.99


def test_page_frames(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "<article><p>" + "long text. " * 40_000 + "</p></article>")], "page_id bigint, url string, html string").selectExpr("*", "'x' as text")
    got = extract_text(df).collect()
    assert [r["text"] for r in got[:3]] == ["", "", ""] and got[3]["n_chars"] == len("long text. ") * 40_000 - 1
    assert extract_text(df.filter("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_pages_of_the_test_data(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = extract_text(pages).collect()
    assert len(got) == pages.count() and all(r["text"] and "&copy;" not in r["text"] for r in got)
