"""Byte-level BPE by corpus-level merge replay.

The distinct words of a whole chunk of texts are laid end to end as symbols. An inverted index holds, for each token
pair that the ranks know, the positions where the pair stands. Merges are applied in rank order, each at all of its
positions at once; a merge touches only the two neighbouring pairs, whose new positions join the index under their rank.
"""

from __future__ import annotations

import base64
import functools

import numpy as np

from .bytewords import chunks, pretoken_starts, word_hashes

_NONE = np.int32(2**31 - 1)


class Ranks:
    """Token bytes by rank, and every pair of tokens whose bytes together are a token."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        ids = {t: i for i, t in enumerate(tokens)}
        self.ids = ids
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        keys, ranks = [], []
        for token, rank in ids.items():
            for cut in range(1, len(token)):
                a, b = ids.get(token[:cut]), ids.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(rank)
        # open addressing over a power of two, at most a quarter full
        self.bits = max(10, int(4 * len(keys)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, _NONE, np.int32)
        key, rank = np.array(keys, np.int64), np.array(ranks, np.int32)
        slot = self._slot(key)
        self.probes = 0
        while len(key):
            self.probes += 1
            free = self.slot_key[slot] == -1
            _, won = np.unique(np.where(free, slot, -1), return_index=True)
            won = won[free[won]]
            self.slot_key[slot[won]], self.slot_rank[slot[won]] = key[won], rank[won]
            rest = np.ones(len(key), bool)
            rest[won] = False
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.decimal = [str(i) for i in range(len(tokens))]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        key = a.astype(np.int64) << 20 | b
        slot = self._slot(key)
        found = self.slot_key[slot]
        out = np.where(found == key, self.slot_rank[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


@functools.lru_cache(4)
def load_ranks(path: str) -> Ranks:
    """A rank file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        table = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(table) != list(range(len(table))):
        raise ValueError("ranks must run from 0 without gaps")
    return Ranks([table[i] for i in range(len(table))])


def _one_word(word: bytes, ranks: Ranks) -> list[int]:
    """The lowest pair first, one merge at a time: for words in which a merge made a pair of a lower rank."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(((ranks.ids.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1)))
        if best[0] == _NONE:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks.ids[p] for p in parts]


def _replay(sym: np.ndarray, lengths: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the symbols of words laid end to end: (symbols, alive, words that need _one_word)."""
    n = len(sym)
    heads = np.cumsum(lengths) - lengths
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[heads + lengths - 1] = n
    prv = np.arange(-1, n, dtype=np.int32)  # one more, for writes past the end
    prv[heads] = -1
    sym = np.append(sym, np.int32(0))
    now = np.full(n + 1, _NONE, np.int32)
    inner = np.flatnonzero(nxt < n)
    now[inner] = ranks.pair(sym[inner], sym[inner + 1])
    known = inner[now[inner] != _NONE].astype(np.int32)
    known = known[np.argsort(now[known], kind="stable")]
    present, first = np.unique(now[known], return_index=True)
    begin = dict(zip(present.tolist(), zip(first.tolist(), np.append(first, len(known))[1:].tolist(), strict=True), strict=True))
    later: dict[int, list] = {}
    dead = np.zeros(n, bool)
    odd: list[np.ndarray] = []
    for r in range(len(ranks.tokens)):
        span, new = begin.get(r), later.pop(r, None)
        if span is None and new is None:
            continue
        if new is None:
            at = known[span[0] : span[1]]
        else:
            at = np.unique(np.concatenate(([known[span[0] : span[1]]] if span else []) + new))
        at = at[now[at] == r]
        if not len(at):
            continue
        right = nxt[at]
        if len(at) > 1 and sym[at[0]] == sym[right[0]] or len(at) > 1 and (right[:-1] == at[1:]).any():  # a run of the same pair: every second one
            chained = np.concatenate([[False], right[:-1] == at[1:]])
            run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            right = nxt[at]
        beyond = nxt[right]
        sym[at] = r
        dead[right] = True
        now[right] = _NONE
        nxt[at] = beyond
        prv[beyond] = at
        prv[n] = -1
        before = prv[at]
        now[at] = _NONE
        follows = at[beyond < n]
        leads = before[before >= 0]
        where = np.concatenate([follows, leads])
        if not len(where):
            continue
        value = ranks.pair(sym[where], sym[nxt[where]])
        now[where] = value
        keep = value != _NONE
        where, value = where[keep], value[keep]
        if not len(where):
            continue
        low = value < r
        if low.any():
            odd.append(where[low])
            where, value = where[~low], value[~low]
        if len(where) < 24:
            for p, v in zip(where.tolist(), value.tolist(), strict=True):
                later.setdefault(v, []).append(np.array([p], np.int32))
        else:
            order = np.argsort(value, kind="stable")
            where, value = where[order], value[order]
            cut = np.flatnonzero(value[1:] != value[:-1]) + 1
            for v, part in zip(value[np.concatenate([[0], cut])].tolist(), np.split(where, cut), strict=True):
                later.setdefault(v, []).append(part)
    bad = np.unique(np.searchsorted(heads, np.concatenate(odd), side="right") - 1) if odd else np.zeros(0, np.int64)
    return sym[:n], ~dead, bad


def encode_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words end to end, ids per word) of byte words."""
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    heads = np.cumsum(lengths) - lengths
    own = data[np.arange(int(lengths.sum())) + np.repeat(starts - heads, lengths)]
    sym, alive, bad = _replay(ranks.byte_id[own], lengths, ranks)
    counts = np.add.reduceat(alive, heads, dtype=np.int64)
    ids = sym[alive]
    if len(bad):
        at = np.cumsum(counts) - counts
        fixed = {int(w): _one_word(own[heads[w] : heads[w] + lengths[w]].tobytes(), ranks) for w in bad}
        pieces, done = [], 0
        for w, got in fixed.items():
            pieces += [ids[done : at[w]], np.array(got, np.int32)]
            done = int(at[w] + counts[w])
            counts[w] = len(got)
        ids = np.concatenate([*pieces, ids[done:]])
    return ids, counts


def _word_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of some words end to end."""
    heads = np.cumsum(lengths) - lengths
    return data[np.arange(int(lengths.sum())) + np.repeat(starts - heads, lengths)]


class Encoder:
    """Encodes texts batch by batch. Words met before are looked up, a batch's new words go through one replay.

    A lookup goes by hash and then compares the bytes; a word whose hash another word holds is kept in a table of its own.
    The store of known words is emptied at the start of a batch once it holds ``known_limit`` words, so memory is bounded.
    """

    def __init__(self, ranks: Ranks, known_limit: int = 1 << 18):
        self.ranks, self.known_limit = ranks, known_limit
        self._clear()

    def _clear(self) -> None:
        self.bits = 16
        self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n, self.hashes = 0, np.zeros(0, np.uint64)
        self.raw, self.raw_at, self.raw_len = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.holders, self.twins = np.zeros(0, np.int32), {}
        self.counts, self.at, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of the word that holds each hash, or -1."""
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == h, self.entry[slot], -1)
        open_ = np.flatnonzero((found != h) & (found != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            found = self.keys[slot[open_]]
            hit = found == h[open_]
            out[open_[hit]] = self.entry[slot[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.entry[slot[won]] = h[won], entry[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, entry, slot = h[rest], entry[rest], (slot[rest] + 1) & mask

    def _learn(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of new words, laid end to end in raw; they can be looked up once their hashes are placed."""
        entry = np.arange(self.n, self.n + len(lengths), dtype=np.int32)
        ids, counts = encode_words(raw, np.cumsum(lengths) - lengths, lengths, self.ranks)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(counts) - counts])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
        self.raw_at = np.concatenate([self.raw_at, len(self.raw) + np.cumsum(lengths) - lengths])
        self.raw_len, self.raw = np.concatenate([self.raw_len, lengths]), np.concatenate([self.raw, raw])
        self.n += len(lengths)
        return entry

    def _hold(self, h: np.ndarray, entry: np.ndarray) -> None:
        self.hashes = np.concatenate([self.hashes, h])
        self.holders = np.concatenate([self.holders, entry])
        if 3 * len(self.hashes) > 1 << self.bits:
            self.bits = int(4 * len(self.hashes)).bit_length()
            self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(self.hashes, self.holders)
        else:
            self._place(h, entry)

    def _unlike(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Which words differ from the known words that hold their hashes; the words follow one another in data."""
        same = self.raw_len[known] == lengths
        if same.all():
            if len(starts) and int(lengths.sum()) == len(data):  # the words tile the data
                differs = self.raw[np.arange(len(data)) + np.repeat(self.raw_at[known] - starts, lengths)] != data
                return np.flatnonzero(np.bitwise_or.reduceat(differs, starts)) if differs.any() else np.zeros(0, np.int64)
            at = np.arange(len(starts))
        else:
            at = np.flatnonzero(same)
        bad = np.flatnonzero(~same)
        if len(at):
            mine, held = _word_bytes(data, starts[at], lengths[at]), _word_bytes(self.raw, self.raw_at[known[at]], lengths[at])
            differs = mine != held
            if differs.any():
                heads = np.cumsum(lengths[at]) - lengths[at]
                bad = np.union1d(bad, at[np.bitwise_or.reduceat(differs, heads)])
        return bad

    def _settle(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, known: np.ndarray) -> None:
        """Give words whose hash another word holds their own numbers, by their bytes."""
        bad = self._unlike(data, starts, lengths, known)
        if not len(bad):
            return
        words = [data[starts[i] : starts[i] + lengths[i]].tobytes() for i in bad.tolist()]
        new = list(dict.fromkeys(w for w in words if w not in self.twins))
        if new:
            got = self._learn(np.frombuffer(b"".join(new), np.uint8), np.array([len(w) for w in new], np.int64))
            self.twins.update(zip(new, got.tolist(), strict=True))
        known[bad] = [self.twins[w] for w in words]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        """For each chunk: (number of each pre-token's word, first pre-token of each text, first row, row after the last)."""
        if self.n >= self.known_limit:
            self._clear()
        parts, new_hash, new_bytes, new_len = [], [], [], []
        for a, b in chunks(offsets):
            own, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, first = pretoken_starts(own, off)
            lengths = np.diff(np.append(starts, len(own)))
            h = word_hashes(own, starts, lengths) | np.uint64(1)
            known = self._find(h)
            miss = np.flatnonzero(known < 0)
            got, one = np.unique(h[miss], return_index=True)
            one = miss[one]
            new_hash.append(got)
            new_len.append(lengths[one])
            new_bytes.append(_word_bytes(own, starts[one], lengths[one]))
            parts.append((known, h[miss], miss, own, starts, lengths, first, a, b))
        got, one = np.unique(np.concatenate([np.zeros(0, np.uint64), *new_hash]), return_index=True)
        if len(got):
            lens, raw = np.concatenate(new_len), np.concatenate(new_bytes)
            self._hold(got, self._learn(_word_bytes(raw, (np.cumsum(lens) - lens)[one], lens[one]), lens[one]))
        for known, h, miss, own, starts, lengths, *_ in parts:
            known[miss] = self._find(h)
            self._settle(own, starts, lengths, known)
        return [(known, first, a, b) for known, _, _, _, _, _, first, a, b in parts]

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(first row, row after the last, ids of the rows' texts end to end, where each text's ids start and end) by chunk."""
        for which, first, a, b in self.words(data, offsets):
            each = self.counts[which]
            ends = np.concatenate([[0], np.cumsum(each)])
            ids = self.ids[np.arange(ends[-1]) + np.repeat(self.at[which] - ends[:-1], each)]
            yield a, b, ids, ends[first]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for which, first, a, b in self.words(data, offsets):
            ends = np.concatenate([[0], np.cumsum(self.counts[which])])
            out[a:b] = np.diff(ends[first])
        return out


def decode_ids(ids: np.ndarray, ranks: Ranks) -> np.ndarray:
    """The bytes that ids stand for."""
    lengths = ranks.lengths[ids]
    ends = np.cumsum(lengths)
    return ranks.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(ranks.offsets[ids] - (ends - lengths), lengths)]
