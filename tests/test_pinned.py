"""Queries that SQL cannot express, against plain Python over the same tables."""

import collections
import json
import re
import unicodedata

import pyarrow.parquet as pq
import pytest
from conftest import SF

from skeinwork import registry
from skeinwork.functions import tagging, urls
from skeinwork.functions import text as T
from skeinwork.operators import vectors
from skeinwork.plans.text import PHRASES


def rows(spark, name):
    return [r.asDict() for r in registry.queries()[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def pages():
    return pq.read_table(f"{SF}/pages.parquet").to_pylist()


def mixed(r):
    return f"Ransomware 攻撃{r['doc_id']} arXiv:2608.12345 脆弱性診断 of the {r['text']}"


def test_nfkc(spark, docs):
    assert {r["doc_id"]: r["normal"] for r in rows(spark, "nfkc")} == {r["doc_id"]: unicodedata.normalize("NFKC", mixed(r)) for r in docs}


def test_token_offsets(spark, docs):
    want = collections.Counter()
    for r in docs:
        s = mixed(r)
        for m in re.finditer(r"[a-zA-Z0-9_\-]+", s):
            want[r["doc_id"], m[0].lower(), m.start(), m.end()] += 1
        for m in re.finditer("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+", s):
            for a, b in [(m.start(), m.end()), *((i, i + 2) for i in range(m.start(), m.end() - 1))]:
                want[r["doc_id"], s[a:b], a, b] += 1
    assert collections.Counter((r["doc_id"], r["token"], r["start"], r["end"]) for r in rows(spark, "token_offsets")) == want


def test_hydration(spark, pages):
    got = rows(spark, "hydration")
    assert len(got) == len(pages) and len({json.dumps({k: v for k, v in r.items() if k != "page_id"}) for r in got}) == 1  # the state is put in alike
    first = got[0]
    assert all(json.loads(first[k]) is not None for k in ("next_data", "nuxt_data", "initial_state") if first[k]) and first["n_json_ld"] >= 1 and first["next_data"]


def test_rings(spark, pages):
    ring = urls.Ring(["node0", "node1", "node2"], virtual=100, mark="{node}:{i}", hash_="md5")
    host = {r["page_id"]: re.match(r"[^:/?#]+://([^/?#]*)", r["url"])[1].lower() for r in pages}
    assert {r["page_id"]: r["node"] for r in rows(spark, "domain_route")} == {p: ring.node(h) for p, h in host.items()}
    keys = [str(k) for k in pq.read_table(f"{SF}/orders.parquet")["o_orderkey"].to_pylist()]
    old, new = urls.Ring([f"node{i}" for i in range(5)]), urls.Ring([f"node{i}" for i in range(6)])
    assert {str(r["o_orderkey"]): r["nodes"] for r in rows(spark, "shard_assign")} == {k: old.preference(k, 3) for k in keys}
    want = {k: list(dict.fromkeys(old.preference(k, 3) + new.preference(k, 3))) for k in keys if "node5" in new.preference(k, 3)}
    assert {str(r["o_orderkey"]): r["holders"] for r in rows(spark, "rebalance")} == want
    # one point on the ring by hand: the next one clockwise owns it
    at = ring.point("some.host")
    assert ring.node("some.host") == min(((p - at) % 2**64, n) for p, n in zip(ring.points.tolist(), ring.owners, strict=True))[1]


def test_records(spark, docs):
    got = {r["doc_id"]: r["okf"] for r in rows(spark, "okf_render")}
    for r in docs:
        title = f"{PHRASES[r['doc_id'] % len(PHRASES)]} {(r['text'] or '').split(chr(10))[0]}"
        low = f"{title} {title} {r['text']} cs.cr".lower()
        domain = next((n for n, ks in tagging.DOMAINS.items() if any(k in low for k in ks)), tagging.OTHER_DOMAIN)
        whole = f"{title} {r['text']}".lower()
        tags = sorted({"cs.CR", domain, *(n for n, ks in tagging.TAGS.items() if any(k in whole for k in ks))})
        quoted = title.replace('"', "'")
        head = f'---\ntype: "paper"\ntitle: "{quoted}"\nresource: "urn:doc:{r["doc_id"]}"\ntags:\n' + "\n".join(f'  - "{t}"' for t in tags)
        assert got[r["doc_id"]] == f'{head}\nprovenance:\n  origin: "{r["source"] or ""}"\n---\n\n# {title}\n\n{r["text"]}\n'


def test_raw_items(spark, pages):
    got = {r["id"]: r for r in rows(spark, "raw_items")}
    for p in pages:
        body = re.sub(r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ", p["html"])
        body = re.sub("<[^>]+>", " ", body)
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            body = body.replace(name, char)
        assert got[str(p["page_id"])]["abstract"] == re.sub(r"[ \t\n\x0b\f\r]+", " ", body).strip(" ")


def test_sketches(spark):
    r = rows(spark, "hll_ndv")[0]
    exact = len(set(pq.read_table(f"{SF}/orders.parquet")["o_custkey"].to_pylist()))
    assert r["exact"] == exact and abs(r["estimate"] - exact) <= 0.05 * exact


def test_text_neighbours(spark, docs):
    """The embedding as written out token by token, and its ten best by inner product."""
    import hashlib
    import math

    import numpy as np

    def embed(text):
        out, low = np.zeros(128), (text or "").lower().strip()
        for t in vectors.EMBED_TOKEN.findall(low):
            h = int(hashlib.sha256(t.encode()).hexdigest()[:16], 16)
            out[h % 128] += (-1.0 if h >> 8 & 1 else 1.0) * (1 + math.log1p(len(t)))
        for i in range(len(low) - 2):
            h = int(hashlib.sha256(low[i : i + 3].encode()).hexdigest()[:8], 16)
            out[h % 128] += -0.5 if h >> 4 & 1 else 0.5
        n = np.linalg.norm(out)
        return out / n if n else out

    some = docs[:40]
    got = {r["doc_id"]: r["vector"] for r in rows(spark, "embed")}
    assert all(np.allclose(got[r["doc_id"]], embed(r["text"])) for r in some)
    q = embed("the heat of the")
    want = sorted(((round(-float(np.dot(v, q)), 9), i) for i, v in got.items()))[:10]
    assert [r["doc_id"] for r in rows(spark, "knn_text")] == [i for _, i in want]


def test_explain(spark):
    text = "\n".join(r["step"] for r in rows(spark, "explain"))
    assert "Scan parquet" in text and "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,100)]" in text and "HashAggregate" in text


def test_markdown(spark, docs):
    got = {r["doc_id"]: r["html"] for r in rows(spark, "md_tokens")}
    assert len(got) == len(docs) and all(h.startswith("<h1>") and "<li><em>one</em></li>" in h for h in got.values())
    assert T.WORD
