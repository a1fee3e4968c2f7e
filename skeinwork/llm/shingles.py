"""Distinct word shingles of whole texts as 128-bit hashes, and their MinHash signatures, vectorised over chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .bytewords import chunks, mix64, utf8_view, word_hashes

WIDTH = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_MIX = np.random.default_rng(11).integers(1, 1 << 63, (2, WIDTH + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chunk_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two 64-bit hashes of each shingle, repeats included, and each text's first, n + 1 values) of texts laid end to end.

    A text of one to four words has its whole word sequence as one shingle; one without words has none.
    """
    low, gap = _LOWER[data], _GAP[data]
    n, texts = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~gap & (edge[:n] | np.concatenate([[True], gap[:-1]])))
    ends = np.flatnonzero(~gap & (edge[1:] | np.concatenate([gap[1:], [True]]))) + 1
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    each = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(each)])
    long = np.flatnonzero(count >= WIDTH)
    span = each[long]
    steps = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
    place, source = steps + np.repeat(at[long], span), steps + np.repeat(first[long], span)
    both = []
    for which in range(2):
        words = word_hashes(low, starts, ends - starts, which)
        mul = _MIX[which]
        whole = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
        for i in range(WIDTH):
            whole += words[i : i + len(whole)] * mul[i]
        out = np.zeros(at[-1], np.uint64)
        out[place] = whole[source]
        for k in range(1, WIDTH):
            few = np.flatnonzero(count == k)
            for i in range(k):
                out[at[few]] += words[first[few] + i] * mul[i]
            out[at[few]] += np.uint64(k * int(mul[WIDTH]) % (1 << 64))
        both.append(mix64(out))
    return *both, at


def column_sets(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, both hashes of the distinct shingles in order text by text, each text's first) of a string column."""
    data, offsets = utf8_view(column)
    for a, b in chunks(offsets):
        one, two, at = chunk_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        order = np.concatenate([np.zeros(0, np.int64), *[i + np.argsort(one[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]])
        first, second = one[order], two[order]
        alike = np.zeros(len(first), bool)
        alike[1:] = first[1:] == first[:-1]
        alike[at[:-1][at[:-1] < len(first)]] = False
        if (second[1:][alike[1:]] != second[:-1][alike[1:]]).any():  # two shingles share one hash: order by both
            owner = np.repeat(np.arange(b - a), np.diff(at))
            order = np.lexsort((two, one, owner))
            first, second = one[order], two[order]
            alike[1:] &= (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        kept = np.concatenate([[0], np.cumsum(~alike)])
        yield a, b, first[~alike], second[~alike], kept[at]


def pack_sets(one: np.ndarray, two: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each text's set as bytes: all first hashes, then all second ones."""
    return [one[i:j].tobytes() + two[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def unpack_set(raw) -> np.ndarray:
    """(2, n) hashes of a packed set."""
    return np.frombuffer(raw, np.uint64).reshape(2, -1)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two unpacked sets."""
    if x.shape[1] > y.shape[1]:
        x, y = y, x
    if not x.shape[1]:
        return 0
    at = np.minimum(np.searchsorted(y[0], x[0]), y.shape[1] - 1)
    first = y[0][at] == x[0]
    both = first & (y[1][at] == x[1])
    if both.sum() != first.sum():  # one hash alike, the other not
        return len(set(zip(*x.tolist(), strict=True)) & set(zip(*y.tolist(), strict=True)))
    return int(both.sum())


def shingle_codes(sets: list[np.ndarray]) -> np.ndarray:
    """A number for each distinct shingle of some sets, set by set."""
    one, two = np.concatenate([x[0] for x in sets]), np.concatenate([x[1] for x in sets])
    names, code = np.unique(one, return_inverse=True)
    held = np.empty(len(names), np.uint64)
    held[code] = two
    if (held[code] != two).any():
        _, code = np.unique(np.stack([one, two]), axis=1, return_inverse=True)
    return code.ravel()


def minhash(hashes: np.ndarray, at: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k values of 16 bits for each set, from its minima under k seeded permutations; an empty set has all ones."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    texts = len(at) - 1
    out = np.full((texts, k), 0xFFFF, np.uint16)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        own = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(k):
            v = own * mul[i] + add[i]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            out[some, i] = np.minimum.reduceat(v, at[some])  # the low bits of the minimum
    return out


def set_digests(sets: list[bytes]) -> list[bytes]:
    """16 bytes for each packed set, equal for equal sets."""
    return [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
