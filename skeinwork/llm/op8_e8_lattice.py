"""Operator 8: embedding near-duplicates by E8 lattice hashing.

Vectors are normalised, and each of TABLES random rotations projects them to BLOCKS runs of eight numbers, which are
scaled, shifted and decoded to the nearest E8 lattice point. The points of all runs are the vector's home cell in that
table; its neighbouring cell, with the least certain run moved to its other coset's point, is probed too. Vectors that
meet in a cell, at least one of them at home, are compared by cosine in double precision, cell by cell in blocks of
bounded size. Only ids are dealt to cells. Cells with the same smallest id, as those of near vectors mostly are, go to
one task, and each vector goes there once, however many of its cells do. A pair that meets in several tables counts in
the first one only, which both vectors' cells tell, so no list of pairs is made: cells yield sums by vector and a
spanning forest of their links.

Identical vectors are one class with a multiplicity; its copies are linked with each other. Vectors that are null, zero,
or hold null or non-finite components link with nothing; vectors of different lengths don't link. Rows with a null id
take part in no link (component_id null, kept false). Rows are vectors each, whatever their ids: repeated rows are
copies, and rows that share an id but not the vector are reported under it each with their own links. Vectors are scaled
by a power of two before products are taken, so tiny and huge ones neither vanish nor overflow. Empty tables give empty
tables; other columns are ignored. A pair of cosine 0.9 exactly meets in one table with probability 0.337 by simulation,
so it is missed with probability 0.0006; with a second probe that is 0.352, which is not worth the third cell a table.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix64
from .components import connected_components
from .components import local_forest as _forest
from .staging import forget, join_counted, stage

TABLES, BLOCKS, SCALE = 18, 3, 2.0
LEAST = 0.9
BLOCK_ROWS = 8192
GROUP_ROWS = 20_000
SEED = 8


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8: integers of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def e8_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest E8 point, the nearest of its other coset, how much farther that is), all points doubled to integers."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    a, b = ((x - whole) ** 2).sum(axis=1), ((x - half) ** 2).sum(axis=1)
    swap = (b < a)[:, None]
    return (2 * np.where(swap, half, whole)).astype(np.int64), (2 * np.where(swap, whole, half)).astype(np.int64), np.abs(a - b)


@functools.lru_cache(8)
def _tables(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng([SEED, dim])
    out = []
    for _ in range(TABLES):
        side = max(dim, 8 * BLOCKS)
        turn = np.linalg.qr(rng.normal(size=(side, side)))[0][:dim, : 8 * BLOCKS]
        out.append((turn * SCALE * np.sqrt(dim / 64), rng.random(8 * BLOCKS)))
    return out


@functools.lru_cache(1)
def _weights() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 62, (BLOCKS, 8), dtype=np.int64) * 2 + 1


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their largest components lie between 0.5 and 1: no rounding, same cosines."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def cells(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home, probe): 64-bit cell keys of each vector in each table."""
    n, dim = vectors.shape
    home, probe = np.empty((n, TABLES), np.int64), np.empty((n, TABLES), np.int64)
    unit = scaled(vectors)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    for t, (turn, shift) in enumerate(_tables(dim)):
        x = unit @ turn + shift
        best = np.zeros(n, np.int64)
        change, least = np.zeros(n, np.int64), np.full(n, np.inf)
        for b in range(BLOCKS):
            point, other, gap = e8_points(x[:, 8 * b : 8 * b + 8])
            key = point @ _weights()[b]
            best += key
            closer = gap < least
            change[closer] = (other @ _weights()[b] - key)[closer]
            least = np.minimum(least, gap)
        salt = np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) ^ np.uint64(dim)
        home[:, t] = mix64(best.astype(np.uint64) ^ salt).astype(np.int64)
        probe[:, t] = mix64((best + change).astype(np.uint64) ^ salt).astype(np.int64)
    return home, probe


def _matrix(column: pa.Array, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) by length, of a binary column of vectors of that kind of float."""
    raw = column.to_pylist()
    sizes = np.array([len(x) for x in raw])
    return [(at, np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)) for at in (np.flatnonzero(sizes == s) for s in np.unique(sizes))]


def usable_vectors(df: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """(id, vec, same): vec holds the components as they are stored; vec and same (a digest of it) are null where it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = []
            for x in batch.column(1).to_pylist():
                v = None if x is None or None in x else np.array(x, kind) + np.array(0, kind)
                vec.append(v.tobytes() if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
            same = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vec]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary()), pa.array(same, pa.binary())], names=["id", "vec", "same"])

    return df.select(key, vector).mapInArrow(run, f"id {dict(df.dtypes)[key]}, vec binary, same binary")


def _in_cells(classes: DataFrame, kind: str) -> DataFrame:
    """(cell, tab, home, cls): every vector at home and at its probe in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                ids = batch.column(0).to_numpy()
                for at, vectors in _matrix(batch.column(1), kind):
                    for home, keys in zip((True, False), cells(vectors), strict=True):
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.ravel()), pa.array(np.tile(np.arange(TABLES, dtype=np.int8), n)), pa.array(np.full(n * TABLES, home)), pa.array(np.repeat(ids[at], TABLES))],
                            names=["cell", "tab", "home", "cls"],
                        )

    return classes.select("cls", "vec").mapInArrow(run, "cell bigint, tab tinyint, home boolean, cls bigint")


def _new_links(i: np.ndarray, j: np.ndarray, tab: np.ndarray, home: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Which pairs i, j, found in table tab, meet in no table before it."""
    open_ = np.arange(len(i))
    for s in range(int(tab.max(initial=0))):
        a, b = i[open_], j[open_]
        met = (s < tab[open_]) & ((home[a, s] == home[b, s]) | (probe[a, s] == home[b, s]) | (home[a, s] == probe[b, s]))
        open_ = open_[~met]
    return open_


def _near_pairs(ids: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, vectors: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell's two blocks with cosine >= least, at least one of them at home, each pair once; vectors are scaled."""
    norms = np.linalg.norm(vectors, axis=1)
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    for lo in range(0, len(a), 1024):
        i = a[lo : lo + 1024]
        x, y = np.nonzero(vectors[i] @ vectors[b].T >= least * norms[i][:, None] * norms[b][None, :])
        x, y = i[x], b[y]
        keep = (home[x] | home[y]) & (ids[x] != ids[y])
        # within one block a pair shows twice, in two different blocks once
        keep &= (x < y) | ~(left[y] & right[x])
        yield x[keep], y[keep]


class _Sums:
    """Links of some cells: sums by row and a forest of row pairs. Pairs are settled in batches of bounded size."""

    LIMIT = 1 << 21

    def __init__(self, ids: np.ndarray, n: np.ndarray, home: np.ndarray, tab: np.ndarray, vectors):
        self.ids, self.n, self.home, self.tab, self.vectors = ids, n, home, tab, vectors
        self.sums, self.open, self.size = np.zeros(len(ids), np.int64), [], 0
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.open.append((x, y))
        self.size += len(x)
        if self.size > self.LIMIT:
            self.settle()

    def settle(self) -> None:
        """Count the pairs that no earlier table has; their vectors' cells are worked out together."""
        if not self.size:
            return
        x, y = (np.concatenate(c) for c in zip(*self.open, strict=True))
        self.open, self.size = [], 0
        # a vector stands in many rows: its cells are needed once
        names, inner = np.unique(self.ids[np.concatenate([x, y])], return_inverse=True)
        first = np.zeros(len(names), np.int64)
        first[inner] = np.concatenate([x, y])
        at_home, at_probe = cells(self.vectors(first))
        p, q, tab = inner[: len(x)], inner[len(x) :], self.tab[x]
        fresh = _new_links(p, q, tab, at_home, at_probe)
        # where either probes the other's home in this table, the pair counts at the smaller id's home
        mutual = (at_home[p, tab] != at_home[q, tab]) & (at_probe[p, tab] == at_home[q, tab]) & (at_home[p, tab] == at_probe[q, tab])
        lower = np.where(self.ids[x] < self.ids[y], self.home[x], self.home[y])
        fresh = fresh[~mutual[fresh] | lower[fresh]]
        np.add.at(self.sums, x[fresh], self.n[y[fresh]])
        np.add.at(self.sums, y[fresh], self.n[x[fresh]])
        low = _forest(p[fresh], q[fresh], len(names))
        own = np.flatnonzero(low != np.arange(len(names)))
        self.edges.append((names[own], names[low[own]]))


def _links_in(table: pa.Table, held: pa.Table, least: float, kind: str) -> pa.Table:
    """(cls, other, n) of some cells' rows and the vectors they name: sums of links (other null) and forest edges (n null)."""
    ids = table["cls"].to_numpy()
    cell, bi, bj, block = (table[c].to_numpy() for c in ("cell", "bi", "bj", "block"))
    home, tab = table["home"].to_numpy(), table["tab"].to_numpy()
    held = held.sort_by("named")
    where = np.searchsorted(held["named"].to_numpy(), ids)
    raw = held["vec"].combine_chunks()
    length, n = pc.binary_length(raw).to_numpy()[where], held["copies"].to_numpy()[where]
    order = np.lexsort((ids, length, bj, bi, cell))
    change = np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(bi[order]) != 0) | (np.diff(bj[order]) != 0) | (np.diff(length[order]) != 0)) + 1
    out_id, out_other, out_n = [], [], []
    groups = np.split(order, change)
    for width in np.unique(length):
        of = np.flatnonzero(pc.binary_length(raw).to_numpy() == width)
        matrix = scaled(np.frombuffer(b"".join(raw.take(pa.array(of)).to_pylist()), kind).reshape(len(of), -1).astype(np.float64))
        take = lambda rows: matrix[np.searchsorted(of, where[rows])]  # noqa: B023, E731
        found = _Sums(ids, n, home, tab, take)
        for rows in groups:
            if len(rows) < 2 or length[rows[0]] != width or not home[rows].any():
                continue
            for x, y in _near_pairs(ids[rows], home[rows], block[rows] == bi[rows], block[rows] == bj[rows], take(rows), least):
                if len(x):
                    found.add(rows[x], rows[y])
        found.settle()
        some = np.flatnonzero(found.sums)
        out_id.append(ids[some])
        out_other += [None] * len(some)
        out_n += found.sums[some].tolist()
        for a, b in found.edges:
            out_id.append(a)
            out_other += b.tolist()
            out_n += [None] * len(a)
    return pa.table({"cls": pa.array(np.concatenate([ids[:0], *out_id]), pa.int64()), "other": pa.array(out_other, pa.int64()), "n": pa.array(out_n, pa.int64())})


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of df; links are pairs found with cosine >= least."""
    kind = "f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "f8"
    usable = stage(usable_vectors(df, key, vector, kind), "vectors")
    known = usable.filter("same is not null and id is not null").groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = stage(known.withColumn("cls", F.monotonically_increasing_id()), "classes")  # written once, so the numbers hold

    rows = stage(_in_cells(classes, kind), "cells")
    busy = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("home").alias("any_home"), F.min("cls").alias("low")).filter("size > 1 and any_home")
    busy = stage(busy.select("cell", "size", "low"), "busy")
    held = busy.agg(F.sum("size").alias("n"), F.max("size").alias("most")).first()
    parts = F.lit((held["n"] or 0) // GROUP_ROWS + 1)
    met = join_counted(rows, busy, "cell", "size").filter("size is not null")
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    if (held["most"] or 0) > BLOCK_ROWS:
        met = met.withColumn("block", F.pmod(F.xxhash64("cls"), blocks.cast("long")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        met = met.withColumn("bi", F.least("block", "with")).withColumn("bj", F.greatest("block", "with"))
    else:
        met = met.select("*", *[F.lit(0).alias(c) for c in ("block", "bi", "bj")])
    part = F.when(blocks == 1, F.pmod(F.xxhash64("low"), parts)).otherwise(F.pmod(F.xxhash64("cell", "bi", "bj"), parts))
    dealt = stage(met.select(part.alias("part"), "cell", "tab", "home", "cls", "block", "bi", "bj"), "dealt")
    named = dealt.select(F.col("part").alias("at"), F.col("cls").alias("named")).distinct()
    vectors = named.join(classes.select(F.col("cls").alias("of"), F.col("n").alias("copies"), "vec"), F.col("named") == F.col("of")).select("at", "named", "copies", "vec")
    found = dealt.groupBy("part").cogroup(vectors.groupBy("at")).applyInArrow(lambda t, v: _links_in(t, v, least, kind), "cls bigint, other bigint, n bigint")
    found = stage(found, "links")
    forget(rows, busy, dealt)

    sums = found.filter("n is not null").groupBy("cls").agg(F.sum("n").alias("links"))
    edges = found.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))
    labels = connected_components(edges)
    named = classes.select("same", "rep", "n", "cls").join(sums, "cls", "left").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    named = stage(named.select("same", "rep", "n", "links", F.coalesce("component", "cls").alias("component")), "named")
    lowest = stage(named.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("many")), "lowest")
    facts = stage(join_counted(named, lowest, "component", "many").select("same", "n", "links", "least"), "facts")
    forget(classes, found, named, lowest)
    out = join_counted(usable.select("id", F.when(F.col("id").isNotNull(), F.col("same")).alias("same")), facts, "same")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))
    return out.select(F.col("id").alias(key), n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
