"""Operator 9: token counts through a digest cache.

Normalised content (null is the empty text; nothing else is changed, since any change could change a count) is keyed by
its SHA-256 next to a digest of the tokenizer's file. Stored counts are joined first; each distinct digest that misses
is encoded once, from one row that carries it, and appended to the cache; then every row takes its count from there.

Null doc_id is kept as null; repeated rows each give a row; ties (one content in many rows) are encoded once; empty
tables give empty tables; other columns are ignored. Texts are counted whole whatever their length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import chunks, utf8_view
from .merge_replay import Encoder, Ranks
from .staging import forget, fresh_path, join_counted, stage

BATCH_BYTES = 8 << 20
CACHE_SCHEMA = "digest binary, n_tokens bigint, version string"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: counts of another version are never reused."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


class _Pieces:
    """A SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, column) -> np.ndarray:
        return np.array([len(self.model.encode(t or "", add_bos=False, add_eos=False)) for t in column.to_pylist()], np.int64)


class _Library:
    """A tokenizers file, whole texts through the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, column) -> np.ndarray:
        return np.array([len(x) for x in self.model.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)], np.int64)


class _ByteLevel(_Library):
    """A byte-level BPE tokenizers file: distinct pre-tokens are encoded once per batch by merge replay.

    A text with the string of an added token goes through the library, whose rules for such strings then hold.
    """

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        vocabulary = spec["model"]["vocab"]
        added = {x["content"] for x in spec.get("added_tokens", [])}
        ordered = sorted((i, t) for t, i in vocabulary.items() if t not in added)
        self.marks = [t.encode() for t in added]
        self.words = Encoder(Ranks([bytes(chars[c] for c in t) for _, t in ordered]))

    def count(self, column) -> np.ndarray:
        data, offsets = utf8_view(column)
        out = np.zeros(len(offsets) - 1, np.int64)
        whole = data.tobytes()
        for a, b in chunks(offsets, BATCH_BYTES):
            out[a:b] = self.words.count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        rows: set[int] = set()
        for mark in self.marks:
            at = whole.find(mark)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = whole.find(mark, at + 1)
        for i in rows:
            out[i] = super().count(column.slice(i, 1))[0]
        return out


def _byte_chars() -> dict[str, int]:
    """Byte-level BPE files show each byte as a character: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(2)
def load_tokenizer(path: str):
    if path.endswith(".model"):
        return _Pieces(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout")
    return _ByteLevel(path) if plain else _Library(path)


def _encode_misses(df: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text); rows of one digest lie in one partition, and the first of them counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_tokenizer(path)
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for d in batch.column(0).to_pylist():
                new.append(d not in seen)
                seen.add(d)
            if not all(new):
                batch = batch.filter(pa.array(new))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.count(batch.column(1)), pa.int64())], names=["digest", "n_tokens"])

    return df.mapInArrow(run, T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())]))


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """Stored (digest, n_tokens) of one tokenizer version; a digest appended twice (a retried run) counts once."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException:  # no cache yet
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, path: str, cache_path: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of df.

    cache_path: folder that keeps counts between calls; without one this call starts from an empty cache of its own.
    Rows share a shuffle of digests only; texts move once, to the side of the misses that one row of each stands for. The
    rows of contents with very many copies take their count without a shuffle.
    """
    spark = df.sparkSession
    version, cache_path = tokenizer_version(path), cache_path or fresh_path(spark, "token-cache")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key), F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"), content.alias("content"))
    slim = stage(rows.select(key, "digest", "n_bytes"), "digests")
    distinct = stage(slim.groupBy("digest").agg(F.min(key).alias("carrier"), F.count(F.lit(1)).alias("n")), "distinct")
    misses = distinct.select("digest", "carrier").join(read_cache(spark, cache_path, version), "digest", "left_anti")
    chosen = rows.join(misses.hint("shuffle_hash").withColumnRenamed("digest", "wanted"), (F.col("digest") == F.col("wanted")) & F.col(key).eqNullSafe(F.col("carrier")), "left_semi")
    _encode_misses(chosen.select("digest", "content"), path).withColumn("version", F.lit(version)).write.mode("append").parquet(cache_path)
    counts = stage(distinct.select("digest", "n").join(read_cache(spark, cache_path, version), "digest", "left"), "counts")
    forget(distinct)
    return join_counted(slim, counts, "digest").select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
