"""Queries do the whole job: their rows against DuckDB over whole tables, or against pinned values that a cut would miss."""

import contextlib
import random
import re
from pathlib import Path

import duckdb
import psutil
from conftest import SF
from pyspark.sql import functions as F

from skeinwork import registry
from skeinwork.functions import offsets, text
from skeinwork.operators import vectors


def test_pagerank_takes_all_orders(spark, same_rows):
    same_rows(registry.queries()["pagerank"](spark, SF), registry.oracle_sql()["pagerank"])


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_clocks_of_all_users(spark, tmp_path):
    kinds = ["click", "view", "purchase"]
    events = [(u, kinds[(u * 7 + i * i) % 3]) for u in range(200) for i in range(u * 13 % 9 + u // 20)]
    d = write(spark, tmp_path, "events", events, "user_id long, event_type string")
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{d}/events.parquet/*.parquet'")
    for name in ("vclock_order", "frontier_versions"):
        df = registry.queries()[name](spark, d)
        ours = sorted(map(tuple, df.collect()))
        rel = duck.sql(registry.oracle_sql()[name])
        assert ours == sorted(tuple(r) for r in rel.fetchall()) and max(r[0] for r in ours) >= 40


def test_knn_graph_meets_all_rows(spark, same_rows, monkeypatch):
    sql = registry.oracle_sql()["knn_graph"]
    same_rows(registry.queries()["knn_graph"](spark, SF), sql)
    monkeypatch.setattr(vectors, "GRAPH_BLOCK", 100)  # six blocks a side
    same_rows(registry.queries()["knn_graph"](spark, SF), sql)


def test_raw_items_keep_the_whole_text(spark, tmp_path):
    html = f"<title>T</title><script>no</script><p>{'word ' * 900}end</p>"
    d = write(spark, tmp_path, "pages", [(1, "https://a.org/x", html)], "page_id long, url string, html string")
    item = registry.queries()["raw_items"](spark, d).first()
    assert item["abstract"].endswith("word end") and item["abstract"].count("word") == 900


def test_multi_sort_returns_all_customers(spark, tmp_path):
    d = write(spark, tmp_path, "customer", [(i, "ab"[i % 2], float(i % 7)) for i in range(500)], "c_custkey long, c_mktsegment string, c_acctbal double")
    rows = [tuple(r) for r in registry.queries()["multi_sort"](spark, d).collect()]
    assert rows == sorted((("ab"[i % 2], float(i % 7), i) for i in range(500)), key=lambda r: (r[0], -r[1], r[2]))


def python_workers(field):
    """MB of a field of /proc/<pid>/status of each of Spark's Python workers, by its folder."""
    out = {}
    for p in psutil.Process().children(recursive=True):
        with contextlib.suppress(psutil.Error, OSError):
            if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name():
                out[Path(f"/proc/{p.pid}")] = int(re.search(rf"{field}:\s+(\d+)", Path(f"/proc/{p.pid}/status").read_text())[1]) / 1024
    return out


def test_token_offsets_hold_no_batch_of_tokens(spark):
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("key"), F.repeat(F.lit("a "), 1000).alias("s"))
    found = offsets.token_offsets(df, "key", "s")
    before = python_workers("VmRSS")
    for p in before:
        with contextlib.suppress(OSError):
            (p / "clear_refs").write_text("5")  # peaks count from now on
    assert found.agg(F.count("*"), F.countDistinct("key", "start"), F.sum("end"), F.max("token")).first()[:] == (3_000_000, 3_000_000, 3000 * 1000 * 1000, "a")
    more = [mb - before.get(p, 0) for p, mb in python_workers("VmHWM").items()]
    assert more and max(more) < 400


def test_token_offsets_of_long_texts(spark):
    rng = random.Random(3)
    words = ["Ab", "c-d_9", "攻", "攻撃診断", "x攻撃y", "é", "\U0001f600", "K", "ァヿ"]
    texts = ["".join(rng.choice(words) + rng.choice(" \n.") for _ in range(2 * offsets.SLAB // 4)), "Z" * (offsets.SLAB + 5) + "診" * (offsets.SLAB + 5), "", None, "。", "end"]
    assert len(texts[0]) > offsets.SLAB
    want = []
    for k, s in enumerate(texts):
        want += [(k, m[0].lower(), *m.span()) for m in re.finditer(text.WORD, s or "")]
        for m in re.finditer(text.CJK_RUN, s or ""):
            want += [(k, m[0], *m.span()), *((k, s[i : i + 2], i, i + 2) for i in range(m.start(), m.end() - 1))]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, s string")
    assert sorted(map(tuple, offsets.token_offsets(df, "key", "s").collect())) == sorted(want)
