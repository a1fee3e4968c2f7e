"""Vectorised text primitives over Arrow buffers: UTF-8 views, pre-token boundaries, word hashes.

Everything works on a chunk of whole texts laid end to end, so the cost per text is a slice, not a Python loop.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
"""Texts are worked through in chunks of about this many bytes; one longer text is a chunk of its own."""

_SEED = 0x5EED_1E55


def utf8_view(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


@functools.lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 letter, 2 number, 3 white space (Unicode White_Space)."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, k in ((r"\p{L}", 1), (r"\p{N}", 2), (r"\p{White_Space}", 3)):
        found = "".join(regex.findall(pattern, every))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = k
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of valid UTF-8."""
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cps) == len(data):
        return cps, np.arange(len(cps), dtype=np.int64)
    return cps, np.flatnonzero((data & 0xC0) != 0x80)


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where the matches of the byte-level BPE split pattern start, and for each text its first match's number (n + 1 values).

    The pattern's matches tile a text: contractions, then runs of letters, numbers or other signs with one blank before
    them, then white space, whose last character stands apart when something follows it.
    """
    cps, at = code_points(data)
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cls = char_classes()[cps]
    first = np.searchsorted(at, offsets)
    head = np.zeros(n + 1, bool)
    head[first] = True
    blank = cls == 3
    start = np.empty(n, bool)
    start[0] = True
    was, now = blank[:-1], blank[1:]
    start[1:] = now & ~was | ~now & (was & (cps[:-1] != 32) | ~was & (cls[1:] != cls[:-1]))
    last = np.flatnonzero(was & ~now & ~head[1:n])
    start[last] = True
    start |= head[:n]
    quotes = np.flatnonzero((cps == 39) & start)
    if len(quotes):
        end = first[np.searchsorted(first, quotes, side="right")]
        pad = np.concatenate([cps, np.zeros(3, np.uint32)])
        c1 = np.where(quotes + 1 < end, pad[quotes + 1], 0)
        c2 = np.where(quotes + 2 < end, pad[quotes + 2], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        k = np.where(one, 1, np.where(two, 2, 0))
        q, k, end = quotes[k > 0], k[k > 0], end[k > 0]
        start[q + 1] = False
        rest = q + k + 1
        start[rest[rest < end]] = True
    words = np.flatnonzero(start)
    return at[words], np.searchsorted(words, first)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SALTS = np.random.default_rng(_SEED).integers(1, 1 << 63, (2, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each byte word, taken eight bytes at a time; which: 0 or 1, two hashes that have nothing in common.

    Words of over 64 bytes are hashed by BLAKE2b, so that no word takes many rounds.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    two = padded[:-1] | padded[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2] | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4] | four[4:].astype(np.uint64) << np.uint64(32)
    a, b = _SALTS[which]
    h = mix64(lengths.astype(np.uint64) * a + b)
    top = int(lengths.max())
    if top <= 8:
        return mix64((h ^ (eight[starts] & _LANE[lengths])) * a + b)
    live = np.arange(len(starts))
    for lo in range(0, min(top, _LONG), 8):
        if lo:
            live = live[lengths[live] > lo]
        lane = eight[starts[live] + lo] & _LANE[np.minimum(lengths[live] - lo, 8)]
        h[live] = mix64((h[live] ^ lane) * a + b)
    for i in np.flatnonzero(lengths > _LONG).tolist():
        word = data[starts[i] : starts[i] + lengths[i]]
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=bytes([which + 1])).digest(), "little")
    return h
