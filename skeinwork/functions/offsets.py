"""Tokens with character offsets, as a table function over batches of texts."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import CJK_RUN, WORD

#: Characters that are looked at together, and tokens that are given out together: a batch of texts has many times its size in tokens.
SLAB, TOKENS = 1 << 18, 1 << 16
_WORD, _RUN = 1, 2
_GAP = re.compile(f"[^{WORD[1:-2]}{CJK_RUN[1:-2]}]")


@functools.cache
def _kinds() -> np.ndarray:
    """Whether words or CJK runs have a character, for each one up to U+FFFF; none beyond is in a token."""
    chars, kinds = "".join(map(chr, range(1 << 16))), np.zeros(1 << 16, np.uint8)
    for kind, pattern in ((_WORD, WORD), (_RUN, CJK_RUN)):
        for m in re.finditer(pattern, chars):
            kinds[m.start() : m.end()] = kind
    return kinds


def _slabs(texts: pa.Array) -> Iterator[list[tuple[int, int, str]]]:
    """(row, offset, piece) of the texts, about SLAB characters at a time; long texts are cut in gaps between tokens only."""
    slab, size = [], 0
    for row, text in enumerate(texts):
        s, a = text.as_py() or "", 0
        while a < len(s):
            gap = _GAP.search(s, a + SLAB)
            b = gap.start() if gap else len(s)
            slab.append((row, a, s[a:b]))
            size, a = size + b - a, b
            if size >= SLAB:
                yield slab
                slab, size = [], 0
    if slab:
        yield slab


def _spans(kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(starts, ends, UTF-8 bytes a character) of at most TOKENS words, or of at most TOKENS CJK runs and bigrams."""
    edges = (np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).astype(np.int32)
    of = kinds[edges[:-1]]
    starts, ends = edges[:-1][of == _WORD], edges[1:][of == _WORD]
    for i in range(0, len(starts), TOKENS):
        yield starts[i : i + TOKENS], ends[i : i + TOKENS], 1
    starts, ends = edges[:-1][of == _RUN], edges[1:][of == _RUN]
    chars = np.flatnonzero(kinds == _RUN).astype(np.int32)  # a run's first one stands for the run, each other one for the bigram that it ends
    for i in range(0, len(chars), TOKENS):
        at = chars[i : i + TOKENS]
        first, end = kinds[at - 1] != _RUN, at + np.int32(1)
        end[first] = ends[np.searchsorted(starts, at[first])]
        yield at - ~first, end, 3


def _strings(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    """The spans' characters in lower case; all of them take width bytes."""
    sizes = ends - starts
    stops = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - stops[:-1].astype(np.int32), sizes) + np.arange(stops[-1], dtype=np.int32)
    data = codes[at].tobytes().decode("utf-16-le").lower().encode()
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer((stops * width).astype(np.int32)), pa.py_buffer(data)).cast(kind)


def token_offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, start, end): lower-case words, then CJK runs each followed by its bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in _slabs(batch.column(1)):
                rows, offsets = (np.array([x[k] for x in slab], np.int32) for k in (0, 1))
                begins = np.cumsum([1, *(len(x[2]) + 1 for x in slab[:-1])]).astype(np.int32)
                codes = np.frombuffer("\n".join(["", *(x[2] for x in slab), ""]).encode("utf-32-le"), "<u4")
                codes = np.minimum(codes, 0xFFFF).astype("<u2")
                for starts, ends, width in _spans(_kinds()[codes]):
                    piece = np.searchsorted(begins, starts, "right") - 1
                    moved = offsets[piece] - begins[piece]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows[piece])), _strings(codes, starts, ends, width, batch.schema.field(1).type), pa.array(starts + moved), pa.array(ends + moved)],
                        names=[key, "token", "start", "end"],
                    )

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, token string, start int, end int")
