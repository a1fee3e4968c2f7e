"""Operator 7: byte-level BPE encoding and decoding by corpus-level merge replay.

``encode_texts`` adds the token ids of whole texts, ``decode_texts`` turns ids back into text, ``digest_texts`` returns
digests of both. One pass over the rows, no shuffle; every task works on batches of bounded size.

Null text encodes as the empty text (no ids); repeated rows are encoded alike; an empty table gives an empty table;
columns other than those named are kept by encode/decode and dropped by ``digest_texts``. Very long texts are whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytewords import chunks, utf8_view
from .merge_replay import Encoder, decode_ids, load_ranks

BATCH_BYTES = 8 << 20
"""Texts whose new words share one replay."""


@functools.lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(load_ranks(path))


def encoded(column, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ids of a string column by row range: (first row, row after the last, ids, where each row's ids start and end)."""
    data, offsets = utf8_view(column)
    for lo, hi in chunks(offsets, BATCH_BYTES):
        for a, b, ids, ends in _encoder(path).encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
            yield lo + a, lo + b, ids, ends


def encode_texts(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with its texts' token ids (array<int>) as a new last column; ``into`` must not be a column of df."""
    if into in df.columns:
        raise ValueError(f"df has a column {into}")
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType(), False))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, ends in encoded(batch.column(at), path):
                lists = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(ids, pa.int32()))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, lists], names=[*own.schema.names, into])

    return df.mapInArrow(run, schema)


def decode_texts(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the bytes (binary) that its ids stand for as a new last column; null ids decode as no bytes."""
    if into in df.columns:
        raise ValueError(f"df has a column {into}")
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType())])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in batches:
            out = [decode_ids(np.array(x or [], np.int64), ranks).tobytes() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, into])

    return df.mapInArrow(run, schema)


def digest_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: encodes the whole text, then decodes the ids."""
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in batches:
            for a, b, ids, ends in encoded(batch.column(1), path):
                back = decode_ids(ids, ranks)
                cut = np.concatenate([[0], np.cumsum(ranks.lengths[ids])])[ends]
                names = [ranks.decimal[i] for i in ids.tolist()]
                shown = [hashlib.sha256(" ".join(names[i:j]).encode()).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                whole = [hashlib.sha256(back[i:j]).hexdigest() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ends), pa.int64()), pa.array(shown, pa.string()), pa.array(whole, pa.string())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
