"""Operator 4: exact top-k search over an impact-ordered, score-at-a-time index.

Components are quantised to integers, the impacts. ``build_index`` deals the rows to cells around pivots and cells to
blocks, and stores each block's postings (row, component, impact) as segments of descending quantised impact, beside the
block's vectors, once, as a table. A search takes two turns over it. In the first each query meets one block of its
nearest cell, which gives it k real scores, the least of them its floor. In the second it goes to the blocks of those
cells only that a ball around their pivot lets reach the floor. A block takes its queries in batches, segment by segment:
what is still to come is bounded for each row by the Cauchy-Schwarz product of the query's norm and the norm of the
row's remaining impacts, and by the largest impact left. Rows whose bound lies below the query's floor or its k-th best
proven score cannot be members; a query for which few rows are left leaves the block and those are rescored exactly, the
others go on to the next segment. If bounds never prove it, all segments are processed. Index rows are moved to their
block once and never copied for queries; queries are copied to the blocks that they could not be proven to skip, and
stream past a block, so a task holds one block and one batch of them. What a query has found in a task's blocks raises
its floor for the next ones, and a task gives out no more than k rows a query.

The pivots come from a bounded sample (SAMPLE rows by hash, at most PIVOTS of them); that decides what can be skipped,
never what is found. Vectors that are null or hold null or non-finite components take no part, nor do those whose impacts
have a norm of 2**31 or more, as their scores may not fit a long; short vectors count as padded with zeros. A query's own
row, and any row with its id, is no candidate; other repeated rows are candidates each. Ties go to the smaller id. Rows
with a null id take no part. Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import forget, parts_for, stage

ROW_BLOCK, QUERY_BATCH = 8192, 256
PIVOTS, SAMPLE, ROWS_A_PIVOT = 1024, 8192, 1024
STEPS, ENERGY = 32, (0.8, 0.96)
"""Impacts are quantised to so many steps; segments end at the steps by which these shares of a block's squared impacts are in."""
FEW = 0.1
"""A query leaves a block once at most this share of its rows, or twice k, can still be members: rescoring so many costs no more than a segment."""
HELD = 100_000
"""A task gives out its answers once it holds those of more queries."""
LAYOUT = "block bigint, kind tinyint, level int, id bigint, floor bigint, a binary, b binary, c binary, x double"
BASE, SEGMENT, QUERY = 0, 1, 2


def impacts(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, vec): floor(scale * component) as int32 binary, of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vec = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or x is None or None in x:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(scale * np.array(x, np.float64))
                    short = np.isfinite(v).all() and (v * v).sum() < 2.0**62
                if short:
                    ids.append(i)
                    vec.append(v.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vec, pa.binary())], names=["id", "vec"])

    return df.select(key, vector).mapInArrow(run, "id bigint, vec binary")


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    if all(len(x) == 4 * width for x in raw):
        return np.frombuffer(b"".join(raw), np.int32).reshape(len(raw), width)
    out = np.zeros((len(raw), width), np.int32)
    for i, x in enumerate(raw):
        out[i, : len(x) // 4] = np.frombuffer(x, np.int32)
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))


def choose_pivots(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Centres of a bounded sample of the rows."""
    drawn = rows.select("vec", F.xxhash64("id", "vec").alias("h")).orderBy("h").limit(SAMPLE).toPandas()["vec"].tolist()
    x = _matrix(drawn, width).astype(np.float64)
    pivots = x[:: max(1, len(x) // max(1, min(PIVOTS, n // ROWS_A_PIVOT)))][:PIVOTS].copy()
    for _ in range(4):
        own = _nearest(x, pivots)[0]
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, x)
        many = np.bincount(own, minlength=len(pivots))[:, None]
        pivots = np.where(many > 0, sums / np.maximum(many, 1), pivots)
    return pivots


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, distance to it) of each row."""
    own = ((pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T)).argmin(axis=1)
    return own, np.sqrt(((x - pivots[own]) ** 2).sum(axis=1))


def segments(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, component, impact) of a block's postings by descending quantised impact, and the largest impact left after each segment."""
    size = np.abs(rows.astype(np.int64))
    step = size * STEPS // (int(size.max(initial=0)) + 1)
    energy = np.bincount(step.ravel(), weights=(size.astype(np.float64) ** 2).ravel(), minlength=STEPS)[::-1].cumsum()
    cuts = sorted({STEPS - 1 - int(np.searchsorted(energy, e * energy[-1])) for e in ENERGY} | {0}, reverse=True) if len(size) else [0]
    out, high = [], STEPS
    for low in cuts:
        at, comp = np.nonzero((step >= low) & (step < high) & (size > 0))
        left = size[step < low]
        out.append((at, comp, rows[at, comp], int(left.max(initial=0))))
        high = low
    return out


class Block:
    """One block of the index, as its stored rows come in."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, centre: np.ndarray, radius: float):
        self.ids, self.rows, self.centre, self.radius = ids, rows, centre, radius
        self.norms, self.parts = _norms(rows), []
        self.seen, self.skipped = 0, 0

    def add(self, at: np.ndarray, comp: np.ndarray, impact: np.ndarray, left: int) -> None:
        self.parts.append((at, comp, impact, left))

    def _dense(self, level: int, kind: type) -> np.ndarray:
        at, comp, impact, _ = self.parts[level]
        out = np.zeros(self.rows.shape, kind)
        out[at, comp] = impact
        return out

    def _rests(self) -> list[np.ndarray]:
        left, out = (self.rows.astype(np.float64) ** 2).sum(axis=1), []
        for at, _, impact, _ in self.parts:
            left = left - np.bincount(at, weights=impact.astype(np.float64) ** 2, minlength=len(self.ids))
            out.append(np.sqrt(np.maximum(left, 0)))
        return out

    def search(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, rows, exact scores) of every possible member of each query's top k with at least its floor."""
        norm, total = _norms(queries), np.abs(queries.astype(np.float64)).sum(axis=1)
        most = float(self.norms.max(initial=0)) * float(norm.max(initial=0))
        kind = np.float32 if most < 1 << 24 else np.float64
        slack = 0.5 if most < 1 << 24 else 0.5 + most * 2.0**-45
        reach = queries.astype(np.float64) @ self.centre + norm * self.radius
        open_ = np.flatnonzero(reach * (1 + 1e-9) + slack >= floors)
        self.seen += len(queries) * len(self.parts)
        self.skipped += (len(queries) - len(open_)) * len(self.parts)
        scores = np.zeros((len(open_), len(self.ids)), kind)
        own = ids[open_][:, None] == self.ids[None, :]
        rests, alive = self._rests(), None
        for level, (_, _, _, left) in enumerate(self.parts):
            if not len(open_):
                return
            scores += queries[open_].astype(kind) @ self._dense(level, kind).T
            bound = np.minimum(norm[open_][:, None] * rests[level][None, :], (total[open_] * left)[:, None]) * (1 + 1e-6) + slack
            least = floors[open_].astype(np.float64)
            if len(self.ids) > k:
                proven = np.where(own, -np.inf, scores - bound)
                least = np.maximum(least, np.partition(proven, -k, axis=1)[:, -k])
            alive = ~own & (scores + bound >= least[:, None])
            many = alive.sum(axis=1)
            done = (many <= max(2 * k, FEW * len(self.ids))) if level < len(self.parts) - 1 else np.ones(len(open_), bool)
            self.skipped += int(done.sum()) * (len(self.parts) - 1 - level)
            for i in np.flatnonzero(done):
                rows = np.flatnonzero(alive[i])
                exact = self.rows[rows].astype(np.int64) @ queries[open_[i]].astype(np.int64)
                rows, exact = rows[exact >= floors[open_[i]]], exact[exact >= floors[open_[i]]]
                best = np.lexsort((self.ids[rows], -exact))[:k]
                yield int(open_[i]), self.ids[rows[best]], exact[best]
            open_, scores, own = open_[~done], scores[~done], own[~done]


def build_index(rows: DataFrame, pivots: np.ndarray, width: int) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """(stored index by LAYOUT, {cell: (its blocks, its radius)}) of (id, vec) rows; a cell is one pivot's rows."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, far = _nearest(_matrix(batch.column(1).to_pylist(), width).astype(np.float64), pivots)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int64()), pa.array(far)], names=["id", "vec", "cell", "far"])

    placed = stage(rows.mapInArrow(place, "id bigint, vec binary, cell bigint, far double"), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("long").alias("n"), F.max("far").alias("far"))
    cells = {r["cell"]: (r["n"], r["far"]) for r in sizes.collect()}  # a row a pivot, of which there are at most PIVOTS
    dealt = placed.join(F.broadcast(sizes.select(F.col("cell").alias("of"), "n")), F.col("cell") == F.col("of"))  # a row a pivot
    block = F.shiftleft("cell", 32) + F.pmod(F.monotonically_increasing_id(), F.col("n"))  # dealt in turn, so repeated rows spread too

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        ids, m = table["id"].to_numpy()[order], _matrix(table["vec"].to_pylist(), width)[order]
        centre = m.astype(np.float64).mean(axis=0)
        radius = float(_norms(m - centre).max())
        found = [(BASE, width, ids.tobytes(), m.tobytes(), centre.tobytes(), radius)]
        for level, (at, comp, impact, left) in enumerate(segments(m)):
            found.append((SEGMENT, level, at.astype(np.uint16).tobytes(), comp.astype(np.uint32).tobytes(), impact.tobytes(), float(left)))
        kind, level, a, b, c, x = zip(*found, strict=True)
        n, blank = len(found), pa.nulls(len(found), pa.int64())
        columns = [pa.array([table["block"][0].as_py()] * n, pa.int64()), pa.array(kind, pa.int8()), pa.array(level, pa.int32()), blank, blank, pa.array(a), pa.array(b), pa.array(c), pa.array(x)]
        return pa.table(columns, names=["block", "kind", "level", "id", "floor", "a", "b", "c", "x"])

    index = stage(dealt.select(block.alias("block"), "id", "vec").groupBy("block").applyInArrow(build, LAYOUT), "index")
    forget(placed)
    return index, cells


class _Best:
    """The best k answers of each query so far in a task, and with them its floor for the task's next blocks."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def floor(self, query: int, given: int) -> int:
        ids, scores = self.held.get(query, ((), ()))
        return max(given, int(scores[-1])) if len(ids) == self.k else given

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.held:
            ids, scores = np.concatenate([self.held[query][0], ids]), np.concatenate([self.held[query][1], scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.held[query] = ids[best], scores[best]

    def drain(self) -> pa.RecordBatch:
        names = np.array(list(self.held), np.int64)
        ids, scores = [x[0] for x in self.held.values()], [x[1] for x in self.held.values()]
        blank = np.zeros(0, np.int64)
        columns = [np.repeat(names, [len(x) for x in ids]), np.concatenate([blank, *ids]), np.concatenate([blank, *scores])]
        self.held = {}
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])


def _search_blocks(k: int, width: int):
    """Streams rows of LAYOUT in order by (block, kind, level): (query_id, vec_id, score), each query's best k of the task's blocks."""

    def answer(best: _Best, block: Block, ids: list, floors: list, vecs: list) -> None:
        floors = np.array([best.floor(i, f) for i, f in zip(ids, floors, strict=True)], np.int64)
        for i, rows, exact in block.search(np.array(ids, np.int64), _matrix(vecs, width), floors, k):
            if len(rows):
                best.add(ids[i], rows, exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, waiting, best = None, None, ([], [], []), _Best(k)
        for batch in batches:
            for at, kind, ident, floor, a, b, c, x in zip(*(batch.column(n).to_pylist() for n in ("block", "kind", "id", "floor", "a", "b", "c", "x")), strict=True):
                if waiting[0] and (at != number or len(waiting[0]) == QUERY_BATCH):
                    answer(best, block, *waiting)
                    waiting = ([], [], [])
                    if len(best.held) > HELD:
                        yield best.drain()
                if kind == BASE:
                    ids = np.frombuffer(a, np.int64)
                    number, block = at, Block(ids, np.frombuffer(b, np.int32).reshape(len(ids), -1), np.frombuffer(c, np.float64), x)
                elif kind == SEGMENT:
                    block.add(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint32), np.frombuffer(c, np.int32), int(x))
                elif at == number:
                    for held, value in zip(waiting, (ident, floor, a), strict=True):
                        held.append(value)
        if waiting[0]:
            answer(best, block, *waiting)
        yield best.drain()

    return run


def _meet(index: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """Answers of queries (block, id, floor, vec) in the blocks that they name."""
    blank = lambda kind: F.lit(None).cast(kind)
    asks = queries.select("block", F.lit(QUERY).cast("tinyint").alias("kind"), F.lit(0).alias("level"), "id", "floor", F.col("vec").alias("a"), blank("binary").alias("b"), blank("binary").alias("c"), blank("double").alias("x"))
    parts = parts_for(index.sparkSession)  # a given number: a block's rows stay in one partition
    both = index.unionByName(asks).repartition(parts, "block").sortWithinPartitions("block", "kind", "level", "id")
    return both.mapInArrow(_search_blocks(k, width), "query_id bigint, vec_id bigint, score bigint")


LOWEST = -(1 << 62)


def top_k(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by inner product of impacts. is_query: of the column id."""
    rows = stage(impacts(df, key, vector, scale), "impacts")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("bytes")).first()
    kind = dict(df.dtypes)[key]
    shown = lambda found: found.select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("vec_id").cast(kind).alias("vec_id"), "score")
    width = (whole["bytes"] or 0) // 4
    if not width:  # no vectors, or none with components: every score is 0
        empty = rows.filter(is_query).select(F.col("id").alias("query_id")).limit(0).selectExpr("query_id", "1 as rank", "query_id as vec_id", "0L as score")
        if not whole["n"]:
            return shown(empty)
        width = 1
    pivots = choose_pivots(rows, whole["n"], width)
    index, cells = build_index(rows, pivots, width)
    queries = rows.filter(is_query)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with one block of the cell whose rows promise the highest scores."""
        names = np.array(sorted(cells))
        many = np.array([cells[c][0] for c in names])
        for batch in batches:
            if batch.num_rows:
                q, ids = _matrix(batch.column(1).to_pylist(), width).astype(np.float64), batch.column(0).to_numpy()
                best = (q @ pivots[names].T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array((names[best].astype(np.int64) << 32) + ids % many[best]), batch.column(0), pa.array(np.full(len(ids), LOWEST)), batch.column(1)], names=["block", "id", "floor", "vec"])

    home = stage(queries.mapInArrow(first, "block bigint, id bigint, floor bigint, vec binary"), "first")
    near = stage(_meet(index, home, k, width), "near")
    floors = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    # rows of one id are one query: what they find adds up, and a floor over several of them would be too high
    single = home.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("id").alias("query_id"))
    floors = floors.join(single, "query_id")
    second = home.join(floors, F.col("id") == F.col("query_id"), "left").select(F.col("block").alias("seen"), "id", F.coalesce("least", "floor").alias("floor"), "vec")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with every other block of the cells that can hold a score of its floor or more."""
        names = np.array(sorted(cells))
        blocks = [(c << 32) + np.arange(cells[c][0], dtype=np.int64) for c in names.tolist()]
        far = np.array([cells[c][1] for c in names])
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                q = _matrix(batch.column(3).to_pylist(), width).astype(np.float64)
                reach = (q @ pivots[names].T + _norms(q)[:, None] * far[None, :]) * (1 + 1e-9) + 1
                may = (reach >= batch.column(2).to_numpy()[:, None]) | (batch.column(2).to_numpy()[:, None] == LOWEST)
                which = [np.concatenate([blocks[0][:0], *[blocks[c] for c in np.flatnonzero(m)]]) for m in may]
                which = [x[x != s] for x, s in zip(which, batch.column(0).to_pylist(), strict=True)]
                own = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in which])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which)), own.column(1), own.column(2), own.column(3)], names=["block", "id", "floor", "vec"])

    far = _meet(index, second.mapInArrow(rest, "block bigint, id bigint, floor bigint, vec binary"), k, width)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return shown(near.unionByName(far).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
