"""PII, language mixtures, source mixing and near-duplicates on small fixtures and against brute force."""

import random
import re
from collections import defaultdict

import duckdb
import pytest
from conftest import SF

from skeinwork.llm import op3_mixing, shingles
from skeinwork.llm.op1_pii import KEY_NAME, MONTHS, SHORT, find, luhn_digit, permute, pseudonymise, scrub
from skeinwork.llm.op2_language import identify, keep_identified, learn
from skeinwork.llm.op3_mixing import mix_rows, plan_mix
from skeinwork.llm import op5_minhash_forest as M
from skeinwork.llm.op5_minhash_forest import candidates, near_duplicates, signatures


def test_permutations():
    for n in (1, 2, 7, 10, 1000):
        assert sorted(permute(i, n, "t", b"k") for i in range(n)) == list(range(n))
    assert permute(5, 1000, "t", b"k") != permute(5, 1000, "t", b"other") or permute(6, 1000, "t", b"k") != permute(6, 1000, "t", b"other")


K = b"test key"


def test_pseudonyms_keep_their_format():
    text = "card 4041894974608795 or 4041-8949-7460-8795, +1 (017) 555-7713 190.137.223.204; 2024-02-29 12.03.1990 ssn 123-45-6789 DE89 3704 0044 0532 0130 00 mail und.34@mail7.example.com."
    new, kinds = scrub(text, K)
    assert sorted(kinds) == sorted(["card", "card", "phone", "ipv4", "date", "date", "ssn", "iban", "email"])
    a, b = re.search(r"card (\d{16}) or ([\d-]{19}),", new).groups()
    assert a == b.replace("-", "") and luhn_digit(a[:-1]) == a[-1] and a != "4041894974608795"
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} ", new) and not any(x in new for x in ("555-7713", "190.137.223.204", "2024-02-29", "123-45-6789", "und.34@", "3704 0044"))
    again, _ = scrub("x 4041 8949 7460 8795", K)
    assert again[2:].replace(" ", "") == a  # linked whatever the grouping
    for clean in ("CC BY-NC 4.0. version 3.", "4041894974608796", "1990-02-30", "000-12-3456", "999.1.1.1", "a@b", "GB00WEST12345698765432", ""):
        assert scrub(clean, K) == (clean, [])


def test_equal_values_are_linked_in_every_notation():
    digits = lambda t: re.sub(r"\D", "", scrub(t, K)[0])
    for numbers in (("+353 1 234 5678", "+35312345678", "+353-1-234-5678"), ("+49 (0)30 1234 5678", "+49 (0) 30 12345678"), ("+1 (212) 555-0123", "+12125550123", "+1-212-555-0123")):
        assert len({digits(n) for n in numbers}) == 1 and digits(numbers[0]) != re.sub(r"\D", "", numbers[0]), numbers
    assert digits("call (212) 555-0123") == digits("call 212-555-0123") == digits("+1 212 555 0123")[1:]
    days = set()
    for text in ("1990-12-25", "1990/12/25", "25.12.1990", "25/12/1990", "12/25/1990", "25 December 1990", "December 25, 1990", "Dec 25, 1990", "25. Dezember 1990", "25 décembre 1990", "25 de diciembre de 1990"):
        new, kinds = scrub(text, K)
        assert kinds == ["date"] and new != text and len(re.findall(r"\D+", new)) == len(re.findall(r"\D+", text)), text
        n = [int(x) for x in re.findall(r"\d+", new)]
        year = max(n)
        words = re.findall(r"[^\W\d]{3,}", new)
        names = [m.lower() for lang in MONTHS.values() for m in lang]
        month = ([names.index(w.lower()) % 12 + 1 for w in words if w.lower() in names] + [SHORT.index(w) + 1 for w in words if w in SHORT] or [next(x for x in n if x <= 12)])[0]
        day = next(x for x in n if x > 12 and x != year)
        days.add((year, month, day))
    assert len(days) == 1
    assert scrub("3 März 1999", K)[0].split()[1] in MONTHS["de"] and scrub("on 3 mars 1999", K)[0].split()[2] in MONTHS["fr"]


def test_dates_are_permuted_one_to_one():
    import datetime

    days = [datetime.date(1900, 1, 1) + datetime.timedelta(i) for i in range(73049)][::7]
    new = [scrub(d.isoformat(), K)[0] for d in days]
    assert len(set(new)) == len(days)
    assert all((datetime.date.fromisoformat(n).day <= 12) == (d.day <= 12) for n, d in zip(new, days, strict=True))


def test_cards_keep_their_network():
    rng = random.Random(1)
    for prefix, size in (("37", 15), ("34", 15), ("4", 16), ("51", 16), ("2221", 16), ("6011", 16), ("3528", 16), ("36", 14), ("300", 14), ("62", 16)):
        for _ in range(20):
            body = prefix + "".join(rng.choices("0123456789", k=size - len(prefix) - 1))
            new, kinds = scrub(body + luhn_digit(body), K)
            assert kinds == ["card"] and new.startswith(prefix) and len(new) == size and luhn_digit(new[:-1]) == new[-1]


def test_long_addresses_leave_nothing_in_clear():
    user, host = "a1" * 60 + "secret" + "b" * 90_000, ".".join(["dept"] * 30)
    new, kinds = scrub(f"to {user}@{host}.org now", K)
    assert kinds == ["email"] and new.startswith("to ") and new.endswith(".org now") and "secret" not in new and "dept" not in new and len(new) == len(f"to {user}@{host}.org now")


def test_finder_against_brute_force():
    """Every substring of short texts that is such a number by itself, with no digit, word or dot beside it."""
    rng = random.Random(2)
    octet = lambda x: x.isdigit() and str(int(x)) == x and int(x) < 256
    ip = lambda x: x.count(".") == 3 and all(octet(p) for p in x.split("."))
    ssn = lambda x: bool(re.fullmatch(r"\d{3}-\d\d-\d{4}", x)) and 1 <= int(x[:3]) <= 899 and x[:3] != "666" and x[4:6] != "00" and x[7:] != "0000"
    for _ in range(400):
        text = " ".join(rng.choice(["1.2.3.4", "256.1.1.1", "10.20.30.40", "001-22-3333", "666-22-3333", "123-45-6789", "123-00-6789", "x9", "7", "1.2.3", "a.b"]) + rng.choice(["", ".", ",", ";", "-", "x", ".5"]) for _ in range(rng.randint(0, 6)))
        want = set()
        for i in range(len(text)):
            for j in range(i + 7, min(len(text), i + 15) + 1):
                before, after = text[i - 1 : i], text[j : j + 1]
                beside = lambda c: c.isalnum() or c == "_"
                if ip(text[i:j]) and not beside(before) and before != "." and not beside(after) and not (after == "." and text[j + 1 : j + 2].isdigit()):
                    want.add((i, j, "ipv4"))
                if ssn(text[i:j]) and not beside(before) and before != "-" and not beside(after) and after != "-":
                    want.add((i, j, "ssn"))
        assert {x[:3] for x in find(text, K) if x[2] in ("ipv4", "ssn")} == want, text


def test_keys(spark):
    df = spark.createDataFrame([(1, "ip 10.1.2.3")], "doc_id bigint, text string")
    own = pseudonymise(df).first()["text"]
    assert own == pseudonymise(df).first()["text"] != "ip 10.1.2.3"
    spark.conf.set(KEY_NAME, "one")
    try:
        one = pseudonymise(df).first()["text"]
        assert one == pseudonymise(df).first()["text"] != own
    finally:
        spark.conf.unset(KEY_NAME)


def test_pseudonymise_frames(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "ip 10.1.2.3", "c"), (3, "ip 10.1.2.3", "c"), (4, "y " * 90_000 + "10.1.2.3", "d")], "doc_id bigint, text string, kinds string")
    rows = pseudonymise(df, found="pii").collect()
    assert [r["text"] for r in rows[:2]] == [None, ""] and rows[2] == rows[3] and rows[2]["text"] != "ip 10.1.2.3" and rows[4]["pii"] == ["ipv4"]
    assert pseudonymise(df.filter("false")).columns == df.columns
    with pytest.raises(ValueError):
        pseudonymise(df, found="kinds")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    r = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = r[r["held_out"]]
    assert len(held) > 200 and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert r["score"].between(0, 1).all()


def test_language_mixtures_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(docs)
    parts = {lang: docs.filter(f"lang = '{lang}' and n_chars > 2000").first()["text"][:1500] for lang in ("de", "fr")}
    odd = spark.createDataFrame([(1, None, "x"), (2, "123 !!", "x"), (3, "", None), (None, parts["de"], None), (5, parts["de"] + " " + parts["fr"], "x")], "doc_id bigint, text string, score string")
    from skeinwork.llm.op2_language import predict

    got = {r["doc_id"]: r for r in predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0.0
    assert got[None]["lang_pred"] == "de"
    assert sorted(got[5]["languages"]) == ["de", "fr"] and all(0.35 < p < 0.65 for p in got[5]["proportions"])
    assert {r["doc_id"] for r in keep_identified(odd, model, least=0.4).collect()} == {None, 5}
    assert identify(odd.withColumnRenamed("score", "lang").filter("false")).count() == 0
    nothing = learn(docs.filter("false"))
    assert {r["lang_pred"] for r in predict(odd, nothing).collect()} == {"und"}


def test_mixtures_against_plain_em():
    """Proportions and chosen sets as by loops over words and languages, on random likelihoods."""
    import math

    import numpy as np

    from skeinwork.llm.op2_language import BUCKETS, PENALTY, STEPS, mixtures

    rng = np.random.default_rng(8)
    logp = np.log(rng.dirichlet(np.full(BUCKETS, 0.02), 3).T + 1e-7).astype(np.float32)
    first, buckets, words_at, texts = [0], [], [], []
    for _ in range(12):
        words = [rng.choice(BUCKETS, rng.integers(1, 5), p=(p := np.exp(logp[:, rng.integers(3)].astype(float))) / p.sum()).tolist() for _ in range(rng.integers(1, 30))]
        for w in words:
            words_at.append(len(buckets))
            buckets += w
        first.append(len(words_at))
        texts.append(words)
    got = mixtures(logp, np.array(words_at), np.array(buckets), np.array(first))

    def em(like, langs):
        share = {k: 1 / len(langs) for k in langs}
        for _ in range(STEPS):
            new, total = dict.fromkeys(langs, 0.0), 0.0
            for w in like:
                mix = sum(share[k] * math.exp(w[k] - max(w)) for k in langs)
                total += math.log(mix) + max(w)
                for k in langs:
                    new[k] += share[k] * math.exp(w[k] - max(w)) / mix / len(like)
            moved = max(abs(new[k] - share[k]) for k in langs)
            share = new
            if moved <= 2e-3:
                break
        return share, total

    for words, row in zip(texts, got, strict=True):
        like = [[float(sum(logp[b, k] for b in w)) for k in range(3)] for w in words]
        share, _ = em(like, [0, 1, 2])
        order = sorted(range(3), key=lambda k: (-share[k], k))
        single = max(range(3), key=lambda k: sum(w[k] for w in like))
        best, value = {single: 1.0}, sum(w[single] for w in like)
        for m in (2, 3):
            s, total = em(like, sorted(order[:m]))
            if total - PENALTY * math.log(1 + len(words)) * (m - 1) > value:
                best, value = s, total - PENALTY * math.log(1 + len(words)) * (m - 1)
        assert {k for k in range(3) if row[k] > 0} == {k for k, p in best.items() if p > 0}
        assert all(abs(row[k] - p) < 0.02 for k, p in best.items())


def test_many_languages(spark):
    """More labels than the full table holds: fewer buckets each, none left out."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 20, f"l{i:03}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    names, logp = learn(df)
    assert len(names) > 400 and logp.size <= 1 << 25
    long = spark.createDataFrame([(1, "ab cd " * 60_000)], "doc_id bigint, text string")
    from skeinwork.llm.op2_language import predict

    assert predict(long, (names, logp)).first()["lang_pred"] in names


def test_mix_agrees_with_sql(spark, same_rows):
    same_rows(plan_mix(spark.read.parquet(f"{SF}/documents.parquet")), op3_mixing.ORACLE_SQL)


def test_mix_edges(spark):
    rows = [(i, "w " * (1 + i % 5), "big") for i in range(300)] + [(1000, None, "void"), (1001, "a b", None), (1001, "a b", None), (None, "a b c", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as target")
    plan = {}
    for r in plan_mix(df).collect():
        plan.setdefault(r["doc_id"], []).append(r)
    assert len(plan[1001]) == 2 and plan[1001][0] == plan[1001][1] and plan[1000][0]["target"] == 0.0 and plan[None][0]["size"] == 2
    every = [r for rs in plan.values() for r in rs]
    assert all(r["taken"] <= 2 * r["size"] for r in every)
    big = [r for r in every if r["source_size"] > 100]
    assert sum(r["taken"] for r in big) == pytest.approx(big[0]["target"], rel=0.1)
    mixed = mix_rows(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in every)
    long = plan_mix(spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w", "a")], "doc_id bigint, text string, source string")).collect()
    assert {r["doc_id"]: r["size"] for r in long} == {1: 300_000, 2: 1}
    assert plan_mix(df.filter("false")).count() == 0 and mix_rows(df.filter("false")).count() == 0


def _brute(rows):
    """(sets, smallest id reachable) by comparing every pair that shares a shingle."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for j in where[g]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    passage = " ".join(rng.choices(words, k=40))
    rows = []
    for g in range(25):
        base = rng.choices(words, k=rng.randint(8, 120))
        for c in range(rng.choice((1, 2, 3, 40 if g == 0 else 4))):
            text = list(base)
            for _ in range(rng.randint(0, 3) if c else 0):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text) + (" " + passage if g % 3 == 0 else "")))
    rows += [(len(rows) + i, t) for i, t in enumerate((None, "", "  \n", "one two", "ONE\ttwo", "one two three", "a b c d e", "A B C D E", "É b c d e", "é b c d e"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as kept", "'x' as set_key")
    sets, want = _brute(rows)
    got = {r["doc_id"]: r for r in near_duplicates(df).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(0, None, False), (3, 3, True), (7, 3, False), (7, 3, False)]
    assert near_duplicates(df.filter("false")).count() == 0


def test_rows_of_one_document_that_differ(spark):
    """5 has the texts of 9 and of 4, and links them."""
    texts = ["a b c d e f g", "h i j k l m n"]
    df = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (9, texts[0]), (4, texts[1]), (2, "x"), (5, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect())
    assert got == [(2, 1, 2), (4, 3, 4), (5, 0, 5), (5, 3, 4), (5, 3, 4), (9, 3, 4)]


def test_shingles_of_colliding_words():
    """Thue-Morse words, which collide in every polynomial hash modulo a power of two; and both hashes being needed."""
    import numpy as np
    import pyarrow as pa

    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word[:40], word[:41], None]
    (_, _, one, two, at), *_ = shingles.column_sets(pa.array(texts))
    assert at.tolist() == [0, 1, 2, 3, 4, 4] and len(set(one)) == len(set(two)) == 4
    x, y = np.array([[1, 1, 5], [2, 3, 9]], np.uint64), np.array([[1, 5], [3, 8]], np.uint64)
    assert shingles.common(x, y) == 1 and len(set(shingles.shingle_codes([x, y]).tolist())) == 4


def _templates(n, seed=3):
    """Texts of which half share one of five templates, filled in at random so that pairs lie on both sides of the threshold."""
    rng = random.Random(seed)
    common = [[f"t{k}x{i}" for i in range(40)] for k in range(5)]
    rows = []
    while len(rows) < n:
        text = list(rng.choice(common)) if rng.random() < 0.5 else [f"u{rng.randrange(10**9)}" for _ in range(40)]
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(40)] = f"r{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(text)))
        if rng.random() < 0.2:
            text[rng.randrange(40)] = "other"
            rows.append((len(rows), " ".join(text)))
    return rows[:n]


def _truth(rows):
    _, want = _brute(rows)
    return want


def test_forest_alone_finds_most_links(spark, monkeypatch):
    """5,000 texts, half of them crowding in regions: what the sorted orders give without the exact pass, and with it."""
    rows = _templates(5000)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = _truth(rows)
    seen = {}
    find = M.find_links
    monkeypatch.setattr(M, "find_links", lambda *a: seen.setdefault("found", find(*a)))
    monkeypatch.setattr(M, "forget", lambda *a: None)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()} == want
    forest, exact, _ = seen["found"]
    low = {r["node"]: r["component"] for r in M.connected_components(forest).collect()}
    nodes = {r["node"]: r["component"] for r in M.connected_components(forest.unionByName(exact)).collect()}
    # a class counts as found where the forest alone brings it to the smallest class that it can reach
    recall = sum(low.get(i) == r for i, r in nodes.items()) / len(nodes)
    print("recall of the forest alone", recall, "links of the exact pass", exact.count())
    assert recall >= 0.9


def test_orders_give_a_bounded_number_of_neighbours():
    """Every place meets its neighbours of longest prefix; a crowded region gives few candidates a row."""
    import numpy as np

    rng = np.random.default_rng(1)
    path = np.array(sorted(map(tuple, np.concatenate([np.full((3000, 4), 7), rng.integers(0, 3, (3000, 20))], axis=1))), np.uint16)
    tree = np.zeros(3000, np.int32)
    i, j, _, size = M.order_neighbours(tree, path)
    assert (size == 3000).all() and len(i) < 3000 * (M.NEAR + M.BESIDE)
    assert {(k, k + 1) for k in range(2999)} <= set(zip(i.tolist(), j.tolist(), strict=True))
    few = np.array(sorted(map(tuple, rng.integers(0, 2, (40, 24)))), np.uint16)
    i, j, region, size = M.order_neighbours(np.zeros(40, np.int32), few)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if (few[a, :4] == few[b, :4]).all() and size[a] <= M.NEAR}
    assert want <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_borders_between_partitions_lose_nothing(spark):
    """The same candidates however many range partitions there are."""
    rows = [(i, f"a b c d {i % 150} f g h i j k l m n o p q r s t u v {i // 150}") for i in range(400)]
    classes = signatures(spark.createDataFrame(rows, "doc_id bigint, text string")).selectExpr("doc_id as cls", "sig").cache()
    got = []
    for parts in ("1", "7", "200"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            pairs, crowded = candidates(classes)
            got.append(({tuple(r) for r in pairs.collect()}, {tuple(r) for r in crowded.collect()}))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    classes.unpersist()
    assert got[0][0] and all(got[0][0] <= g[0] and got[0][1] == g[1] for g in got[1:])


def test_exact_pass_over_crowded_regions(spark, monkeypatch):
    """Pairs about the threshold among texts that share half of their words, in blocks of seven, with no help from the forest."""
    monkeypatch.setattr(M, "BLOCK", 7)
    rng = random.Random(3)
    shared = [f"c{i}" for i in range(30)]
    rows = []
    for g in range(12):
        own = [f"g{g}x{i}" for i in range(30)]
        for c in range(4):
            text = shared + own
            for _ in range(c):
                text = text[:]
                text[30 + rng.randrange(30)] = f"r{rng.random()}"
            rows.append((len(rows), " ".join(text)))
    signed = signatures(spark.createDataFrame(rows, "doc_id bigint, text string"))
    classes = signed.selectExpr("doc_id as cls", "sig")
    texts = signed.join(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id").selectExpr("doc_id as cls", "set_key", "text")
    _, want = _brute(rows)
    clusters = spark.createDataFrame([(i, i, 0) for i, _ in rows], "cls bigint, component bigint, cluster bigint")
    links = M.exact_links(clusters, classes, M.shingle_sets(texts), 75)
    got = {r["node"]: r["component"] for r in M.connected_components(links).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "bpe"]
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()} and out.filter("n_tokens != size(ids)").count() == 0
    for name, step in corpus_pipeline.STAGES[:-1]:
        empty = step(spark, docs.filter("false"), SF)
        assert empty.columns == docs.columns and empty.count() == 0, name
    odd = docs.limit(20).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (900001, "", None, "s", None), (900002, "the word " * 60_000, "en", None, 1)], docs.schema)).selectExpr("*", "1 as gone", "'x' as n_tokens", "2 as source_size", "3 as copies")
    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, odd, SF)
        assert got.columns == odd.columns and got.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()
    twice = [sorted(map(str, corpus_pipeline.STAGES[1][1](spark, odd, SF).collect())) for _ in range(2)]
    assert twice[0] == twice[1]
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    kept = corpus_pipeline.STAGES[1][1](spark, docs.unionByName(docs.limit(5)), SF)
    assert first.count() >= 0.98 * docs.count() and kept.count() == kept.select("doc_id").distinct().count()
    assert duckdb  # the SQL checks of single operators stand in their own tests
