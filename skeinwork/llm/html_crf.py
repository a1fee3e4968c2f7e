"""A linear-chain conditional random field over a page's leaf blocks: main text or not."""

from __future__ import annotations

import functools
import re

import numpy as np

from .html_blocks import Block, Node, leaf_blocks
from .html_samples import MARK, sample_pages

#: Words in text that speak for notices, menus and the like.
CUES = "cookie cookies consent privacy subscribe newsletter advertisement sponsored copyright rights reserved login register comments reply share follow menu search terms related".split()
_CUE = re.compile(rf"\b(?:{'|'.join(CUES)})\b", re.I)


def _own_names(node: Node) -> list[str]:
    return [f"in={node.tag}", *(f"word={w}" for w in node.words), *(f"pair={node.tag}.{w}" for w in node.words)]


def _above(node: Node | None, slot: str, start, step):
    """What hangs on a node and all around it, worked out from the outside in and kept at each node."""
    path = []
    while node is not None and getattr(node, slot) is None:
        path.append(node)
        node = node.parent
    held = start if node is None else getattr(node, slot)
    for node in reversed(path):
        held = step(held, node)
        setattr(node, slot, held)
    return held


def _context_names(node: Node | None) -> set[str]:
    """The names of a block's features that come from the elements around it."""
    around = _above(node, "names", frozenset(), lambda held, x: held.union(_own_names(x)))
    return {*around, f"tag={node.tag if node else 'none'}", *(f"near={w}" for w in (node.near if node else ()))}


def features(blocks: list[Block]) -> list[list[str]]:
    """The names of each block's features but for those of the elements around it."""
    out = []
    n = len(blocks)
    for i, (text, _, linked) in enumerate(blocks):
        size = len(text)
        words = text.count(" ") + 1
        own = ["bias", f"words={min(6, words.bit_length())}", f"linked={min(4, 4 * linked // max(size, 1))}", f"place={4 * i // n}"]
        if text[-1] in ".!?…\"”»":
            own.append("ends")
        if "©" in text:
            own.append("copyright")
        if text.count(","):
            own.append("comma")
        if words < 30:
            own += [f"cue={c.lower()}" for c in _CUE.findall(text)]
        out.append(own)
    return out


class Crf:
    """Weights of two labels (0 other, 1 main text): emissions by feature, transitions between neighbours."""

    def __init__(self, names: list[str]):
        self.index = {f: i for i, f in enumerate(names)}
        self.emit, self.move = np.zeros((len(names), 2)), np.zeros((2, 2))

    def rows(self, blocks: list[Block]) -> list[list[int]]:
        """The numbers of each block's features that the model knows; of the elements around a block there are as many at most."""
        get = self.index.get

        def more(held: frozenset, node: Node) -> frozenset:
            new = {i for f in _own_names(node) if (i := get(f)) is not None}
            return held if new <= held else held | new

        out = []
        for (_, node, _), own in zip(blocks, features(blocks), strict=True):
            around = _above(node, "known", frozenset(), more)
            here = [f"tag={node.tag if node else 'none'}", *(f"near={w}" for w in (node.near if node else ()))]
            out.append([*(i for f in (*own, *here) if (i := get(f)) is not None), *sorted(around)])
        return out

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.array([i for r in rows for i in r], np.int64)
        heads = np.cumsum([0, *(len(r) for r in rows[:-1])])
        return np.add.reduceat(self.emit[flat], heads, axis=0)

    def learn(self, pages: list[tuple[list[list[int]], np.ndarray]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Gradient ascent (AdaGrad) on the conditional log likelihood, page by page in a fixed order."""
        square, square_move = np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6)
        for turn in range(rounds):
            for k in np.random.default_rng(turn).permutation(len(pages)):
                rows, gold = pages[k]
                s, n = self.scores(rows), len(rows)
                fore, back = np.zeros((n, 2)), np.zeros((n, 2))
                fore[0] = s[0]
                for i in range(1, n):
                    fore[i] = s[i] + np.logaddexp(fore[i - 1, 0] + self.move[0], fore[i - 1, 1] + self.move[1])
                for i in range(n - 2, -1, -1):
                    after = s[i + 1] + back[i + 1]
                    back[i] = np.logaddexp(self.move[:, 0] + after[0], self.move[:, 1] + after[1])
                total = np.logaddexp(*fore[-1])
                gap = np.eye(2)[gold] - np.exp(fore + back - total)
                grad = np.zeros_like(self.emit)
                lens = [len(r) for r in rows]
                flat = np.array([i for r in rows for i in r])
                np.add.at(grad, flat, np.repeat(gap, lens, axis=0))
                used = np.unique(flat)
                move = np.zeros((2, 2))
                if n > 1:
                    np.add.at(move, (gold[:-1], gold[1:]), 1)
                    joint = fore[:-1, :, None] + self.move[None] + (s[1:] + back[1:])[:, None, :] - total
                    move -= np.exp(joint).sum(axis=0)
                g = grad[used] - decay * self.emit[used]
                square[used] += g * g
                self.emit[used] += rate * g / np.sqrt(square[used])
                square_move += move * move
                self.move += rate * move / np.sqrt(square_move)

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest label sequence (Viterbi)."""
        if not blocks:
            return []
        s = self.scores(self.rows(blocks)).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + x, (b + m11 if from1 else a + m01) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


@functools.lru_cache(1)
def trained(pages: int = 500, seed: int = 10) -> Crf:
    """The model trained on labelled pages; the same each time."""
    read = []
    for page in sample_pages(pages, seed):
        blocks = leaf_blocks(page)
        gold = np.array([int(MARK in b.text) for b in blocks])
        read.append(([Block(b.text.replace(MARK, ""), b.context, b.linked) for b in blocks], gold))
    names = sorted({f for blocks, _ in read for fs, b in zip(features(blocks), blocks, strict=True) for f in (*fs, *_context_names(b.context))})
    model = Crf(names)
    model.learn([(model.rows(blocks), gold) for blocks, gold in read])
    return model
