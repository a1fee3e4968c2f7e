"""Byte-level BPE, token counts and their cache."""

import base64
import functools
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skeinwork.llm import bytewords, merge_replay
from skeinwork.llm.op7_bpe import decode_texts, digest_texts, encode_texts, encoded
from skeinwork.llm.op9_token_counts import count_tokens, load_tokenizer

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["it's we'll they've 'sabc ''s don't  \n\n x\t y'd'd '", "\n\n  ", "a  b   c   x  ", "a" * 57, "abab" * 9, "日本語 テキスト １２３ ½ é", "", "  I'm  'LL 'll" + "!?" * 50, "x\u0085y z  ​", None, "<|endoftext|> a<|endoftext|>", "word " * 3000]


@functools.lru_cache(1)
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    out = []
    for a, b, ids, ends in encoded(pa.array(texts, pa.string()), RANKS):
        out += [ids[ends[i] : ends[i + 1]].tolist() for i in range(b - a)]
    return out


def test_ids_are_the_librarys():
    assert ids_of(ODD) == [library().encode_ordinary(t or "") for t in ODD]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_round_trip_of_any_text(texts):
    ranks = merge_replay.load_ranks(RANKS)
    for text, ids in zip(texts, ids_of(texts), strict=True):
        assert merge_replay.decode_ids(pa.array(ids, pa.int64()).to_numpy(), ranks).tobytes() == text.encode()


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab' \n\t's!1éñ中", max_size=40))
def test_any_text_is_encoded_as_by_the_library(text):
    assert ids_of([text]) == [library().encode_ordinary(text)]


def test_words_where_a_merge_makes_a_lower_pair():
    # bc comes first by rank, but ab + c has a lower rank than the merge that makes it possible
    tokens = [bytes([i]) for i in range(256)] + [b"abc", b"bc", b"ab"]
    ranks = merge_replay.Ranks(tokens)
    texts = bytewords.np.frombuffer(b"abcabcabbcbc", bytewords.np.uint8)
    starts, lengths = bytewords.np.array([0, 6, 8]), bytewords.np.array([6, 2, 4])
    ids, counts = merge_replay.encode_words(texts, starts, lengths, ranks)
    assert ids.tolist() == [256, 256, 258, 257, 257] and counts.tolist() == [2, 1, 2]


def test_words_of_one_hash_stay_apart(monkeypatch):
    """Thue-Morse words, which collide in every polynomial hash modulo a power of two; then five hashes for all words."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"{word} {other}", f"{other} {word}"]
    assert ids_of(texts) == [library().encode_ordinary(t) for t in texts]
    hashes = merge_replay.word_hashes
    monkeypatch.setattr(merge_replay, "word_hashes", lambda *a: hashes(*a) % bytewords.np.uint64(5))
    from skeinwork.llm.op7_bpe import _encoder

    _encoder.cache_clear()
    try:
        mixed = [t or "" for t in ODD] + [f"word{i} wore{i}s" for i in range(300)]
        for _ in range(2):
            assert ids_of(mixed) == [library().encode_ordinary(t) for t in mixed]
    finally:
        _encoder.cache_clear()


def test_frames(spark):
    df = spark.createDataFrame([(1, "ab ab", "x"), (1, "ab ab", "x"), (2, None, None), (None, "", "y")], "doc_id bigint, text string, ids_ string")
    back = decode_texts(encode_texts(df, RANKS), RANKS)
    assert [bytes(r["decoded"]).decode() for r in back.collect()] == [r["text"] or "" for r in df.collect()]
    d = digest_texts(df, RANKS).collect()
    assert d[0] == d[1] and d[2]["n_tokens"] == 0 and d[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert digest_texts(df.filter("false"), RANKS).count() == 0
    with pytest.raises(ValueError):
        encode_texts(df.withColumnRenamed("ids_", "ids"), RANKS)


def test_counts_are_the_librarys(spark, tmp_path):
    df = spark.createDataFrame([*[(i, t, i) for i, t in enumerate(ODD)], (0, ODD[0], 9), (None, "null key", 9)], "doc_id bigint, text string, n_tokens int")
    lib = Tokenizer.from_file(JSON)
    want = {t or "": len(lib.encode(t or "", add_special_tokens=False)) for t in [*ODD, "null key"]}
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time from the cache
        got = count_tokens(df, JSON, cache).collect()
        assert len(got) == len(ODD) + 2
        by_id = {r["doc_id"]: r for r in got}
        assert [by_id[i]["n_tokens"] for i in range(len(ODD))] == [want[t or ""] for t in ODD]
        assert by_id[None]["n_tokens"] == want["null key"]
        assert all(r["n_bytes"] == len((ODD[r["doc_id"]] or "").encode()) for r in got if r["doc_id"] is not None)
        assert [by_id[i]["over_limit"] for i in range(len(ODD))] == [want[t or ""] > 512 for t in ODD]
    assert spark.read.parquet(cache).count() == len(want)
    assert count_tokens(df.filter("false"), JSON).count() == 0


def test_other_tokenizers():
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = pa.array(["Hello world", None, ""])
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert load_tokenizer(model).count(texts).tolist() == [len(sp.encode(t or "")) for t in texts.to_pylist()]
    word = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(word)
    assert load_tokenizer(word).count(texts).tolist() == [len(lib.encode(t or "", add_special_tokens=False)) for t in texts.to_pylist()]
