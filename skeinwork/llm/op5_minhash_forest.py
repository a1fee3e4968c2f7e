"""Operator 5: MinHash near-duplicates through an LSH forest of sorted signature orders.

Texts with one set of shingles are one class, found by a digest of the set. Each class has one MinHash signature, and
each of TREES trees puts all classes in order by its own rotation of the signature's values: rows are range partitioned
by (tree, values) and sorted, so a class's neighbours in the order are those with which it shares the longest prefix. A
run of classes that share LEAST values is a region. A region of up to NEAR classes gives all its pairs; a larger one is
cut at longer and longer common prefixes, as deep as its own density asks, until its parts are that small, and each of
its classes also meets the next BESIDE ones in the order. Rows at the ends of range partitions are looked at once more
together with those of the next one. So every order yields a bounded number of candidates a class.

Candidates whose signatures agree in under FLOOR of their values are dropped (a pair at similarity 0.75 does so with
probability 4e-10); the others are confirmed on their full sets, of 128-bit shingle hashes. A first turn confirms every
class's best and its smallest candidate; what then lies within one component needs no check, and a second turn confirms
the rest.

Cutting a crowded region can part a pair in every order. Crowded regions whose classes still lie in several components
are therefore settled exactly: regions that share classes form a cluster; its classes outside its largest component meet
all others of the cluster, in blocks of bounded size, by agreement of signatures and then products of 0/1 matrices of
their shingles, and each two blocks yield a spanning forest of their links, never pairs. Regions that lie in one
component, such as those of copies of one text, cost nothing here.

Null or wordless texts have no shingles and link with nothing. A null doc_id takes no part: component_id null, kept
false. Each row is returned. Rows of one doc_id are one document: equal ones are one class, and where they differ in
content the document has the links of each. Ties go to the smaller doc_id; an empty table gives an empty table; other
columns are ignored; very long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import mix64
from .components import connected_components
from .components import local_forest as _forest
from .shingles import column_sets, common, minhash, pack_sets, set_digests, shingle_codes, unpack_set
from .staging import forget, join_counted, parts_for, row_count, stage

TREES, STEP = 32, 4
VALUES = TREES * STEP
LEAST, DEEPEST = 4, 24
NEAR, BESIDE = 12, 2
FLOOR = 0.5
BLOCK = 512
COLUMNS = 4096
PART_ROWS = 400_000
SEED = 20240611


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, set_key, sig): set_key and sig are null for texts without shingles."""
    schema = T.StructType([df.schema[key], T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, one, two, at in column_sets(batch.column(1)):
                n = np.diff(at)
                sig = minhash(one, at, VALUES, SEED)
                keys = [x if m else None for x, m in zip(set_digests(pack_sets(one, two, at)), n.tolist(), strict=True)]
                sigs = [x.tobytes() if m else None for x, m in zip(sig, n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def shingle_sets(df: DataFrame, text: str = "text") -> DataFrame:
    """(cls, shingles) of (cls, set_key, text): the packed set of each text whose set has that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, one, two, at in column_sets(batch.column(2)):
                sets = pack_sets(one, two, at)
                own = pa.array([x == y for x, y in zip(set_digests(sets), batch.column(1).slice(a, b - a).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(own), pa.array(sets, pa.binary()).filter(own)], names=["cls", "shingles"])

    return df.select("cls", "set_key", text).mapInArrow(run, "cls bigint, shingles binary")


def order_neighbours(tree: np.ndarray, path: np.ndarray, near: int = NEAR, beside: int = BESIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order by (tree, path): the places i < j of candidate pairs, each row's region, and how many rows that has."""
    n = len(tree)
    equal = path[1:] == path[:-1]
    prefix = np.where(equal.all(axis=1), path.shape[1], equal.argmin(axis=1)) if n > 1 else np.zeros(0, np.int64)
    prefix[tree[1:] != tree[:-1]] = 0

    def runs(depth: int) -> tuple[np.ndarray, np.ndarray]:
        region = np.concatenate([[0], np.cumsum(prefix < depth)])[:n]
        return region, np.bincount(region, minlength=1)[region] if n else region

    region, size = runs(LEAST)
    pairs = []
    open_, top, run, many = np.ones(n, bool), region, region, size
    for depth in range(LEAST, path.shape[1] + 1):
        if depth > LEAST:
            run, many = runs(depth)
        now = open_ & (many <= near)
        for step in range(1, near):
            at = np.flatnonzero(now[: n - step] & (many[: n - step] > step))
            at = at[run[at] == run[at + step]]
            if not len(at):
                break
            pairs.append((at, at + step))
        open_ &= ~now
        if not open_.any():
            break
    for step in range(1, beside + 1):
        at = np.flatnonzero(size[: max(0, n - step)] > near)
        at = at[top[at] == top[at + step]]
        pairs.append((at, at + step))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    return i, j, region, size


_ROWS = "a bigint, b bigint, region bigint, part int, place bigint, n bigint, tree int, path binary"


def _rows(many: int, **columns) -> pa.RecordBatch:
    """A batch of _ROWS with the columns given, the others null."""
    kinds = {"part": pa.int32(), "tree": pa.int32(), "path": pa.binary()}
    names = [f.split()[0] for f in _ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(many, kinds.get(c, pa.int64())) for c in names], names=names)


def _read_order(tree: np.ndarray, raw: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """(region keys, region sizes, candidate pairs) of rows in order."""
    path = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1)
    i, j, _, size = order_neighbours(tree, path)
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    both = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    head = np.ascontiguousarray(path[:, :LEAST]).view(np.uint64).ravel()
    return mix64(head ^ mix64(tree.astype(np.uint64) + np.uint64(1))).astype(np.int64), size, _rows(both.shape[1], a=both[0], b=both[1])


def _scan_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range partition of an order: its candidates, the members of crowded regions and of those at its ends, and its end rows."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    tree, ids, raw = table["tree"].to_numpy(), table["cls"].to_numpy(), table["path"].to_pylist()
    region, size, pairs = _read_order(tree, raw, ids)
    yield pairs
    n, place = len(ids), np.arange(len(ids))
    member = np.flatnonzero((size > NEAR) | (region == region[0]) | (region == region[-1]))
    yield _rows(len(member), a=ids[member], region=region[member])
    end = np.flatnonzero((place < NEAR) | (place >= n - NEAR))
    yield _rows(len(end), a=ids[end], part=np.full(len(end), TaskContext.get().partitionId(), np.int32), place=place[end], n=np.full(len(end), n), tree=tree[end], path=[raw[k] for k in end.tolist()])


def _seams(found: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of rows on both sides of the borders between range partitions."""
    spark = found.sparkSession
    ends = found.filter("part is not null")
    sizes = sorted((r["part"], r["n"]) for r in ends.select("part", "n").distinct().collect())  # one row a partition
    seam, border = [], 0
    for part, n in sizes:  # the seam left of a partition and the one right of it, one and the same if all its rows lie in both
        left = border
        border += n >= 2 * NEAR
        seam.append((part, left, border))
    which = F.broadcast(spark.createDataFrame(seam, "at int, l int, r int"))
    sides = ends.join(which, F.col("part") == F.col("at")).select("a", "part", "place", "tree", "path", F.explode(F.array_distinct(F.array_compact(F.array(F.when(F.col("place") < NEAR, F.col("l")), F.when(F.col("place") >= F.col("n") - NEAR, F.col("r")))))).alias("seam"))

    def read(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("place", "ascending")])
        _, _, pairs = _read_order(table["tree"].to_numpy(), table["path"].to_pylist(), table["a"].to_numpy())
        return pa.Table.from_batches([pairs]).select(["a", "b"])

    return sides.groupBy("seam").applyInArrow(read, "a bigint, b bigint")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs (a, b), a < b, of classes (cls, sig) that are neighbours in some order; members (region, cls) of crowded regions)."""
    spark = classes.sparkSession
    rotated = F.expr(f"substring(concat(sig, sig), tree * {2 * STEP} + 1, {2 * DEEPEST})")
    rows = classes.select("cls", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", rotated.alias("path"), "cls")
    parts = max(parts_for(spark), row_count(classes) * TREES // PART_ROWS)
    ordered = rows.repartitionByRange(parts, "tree", "path", "cls").sortWithinPartitions("tree", "path", "cls")
    found = stage(ordered.mapInArrow(_scan_order, _ROWS), "orders")
    pairs = found.filter("b is not null").select("a", "b").unionByName(_seams(found)).distinct()
    members = found.filter("region is not null").select("region", F.col("a").alias("cls"))
    crowded = members.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NEAR).select("region", "n")
    return pairs, stage(join_counted(members, stage(crowded, "regions"), "region").filter("n is not null").select("region", "cls"), "crowded")


def _agreement(pairs: DataFrame) -> DataFrame:
    """(a, b, share of equal values) of (a, b, sig_a, sig_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            alike = (x == y).mean(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.float64())], names=["a", "b", "alike"])

    return pairs.mapInArrow(run, "a bigint, b bigint, alike double")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of (a, b, set_a, set_b): 100 * intersection >= percent * union of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpack_set(x.as_buffer()), unpack_set(y.as_buffer())
                both = common(x, y)
                out.append(100 * both >= percent * (x.shape[1] + y.shape[1] - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    return pairs.mapInArrow(run, "a bigint, b bigint, linked boolean")


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Spanning forest (a, b) of the links between components of two blocks of (cls, component, block, bi, bj, sig, shingles)."""
    table = table.sort_by("cls")
    ids, of, block = table["cls"].to_numpy(), table["component"].to_numpy(), table["block"].to_numpy()
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(ids), -1)
    a, b = np.flatnonzero(block == table["bi"][0].as_py()), np.flatnonzero(block == table["bj"][0].as_py())
    may = np.zeros((len(a), len(b)), bool)
    for lo in range(0, len(a), 64):
        alike = (sig[a[lo : lo + 64]][:, None, :] == sig[b][None, :, :]).sum(axis=2)
        may[lo : lo + 64] = alike >= FLOOR * sig.shape[1]
    may &= of[a][:, None] != of[b][None, :]
    a, b, may = a[may.any(axis=1)], b[may.any(axis=0)], may[may.any(axis=1)][:, may.any(axis=0)]
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not len(a) or not len(b):
        return empty
    used = np.union1d(a, b)
    raw = table["shingles"].combine_chunks()
    sets = [unpack_set(raw[int(i)].as_buffer()) for i in used]
    n = np.array([x.shape[1] for x in sets], np.int64)
    owner, code = np.repeat(np.arange(len(sets)), n), shingle_codes(sets)
    keep = np.bincount(code)[code] > 1
    owner, code = owner[keep], code[keep]
    by = np.argsort(code, kind="stable")
    owner, code = owner[by], np.unique(code[by], return_inverse=True)[1]
    left, right = np.searchsorted(used, a), np.searchsorted(used, b)
    both = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(code.max(initial=-1)) + 1, COLUMNS):
        span = slice(np.searchsorted(code, lo), np.searchsorted(code, lo + COLUMNS))
        ones = np.zeros((len(sets), COLUMNS), np.float32)
        ones[owner[span], code[span] - lo] = 1
        both += ones[left] @ ones[right].T
    x, y = np.nonzero(may & (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)))
    x, y = left[x], right[y]
    low = _forest(x, y, len(used))
    own = np.flatnonzero(low != np.arange(len(used)))
    return pa.table({"a": pa.array(ids[used[low[own]]], pa.int64()), "b": pa.array(ids[used[own]], pa.int64())})


def _part_links(table: pa.Table, percent: int) -> pa.Table:
    """_block_links of every (cluster, bi, bj) of one task's rows."""
    table = table.sort_by([(c, "ascending") for c in ("cluster", "bi", "bj")])
    keys = np.stack([table[c].to_numpy() for c in ("cluster", "bi", "bj")])
    cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
    return pa.concat_tables([_block_links(table.slice(a, b - a), percent) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])


def open_regions(crowded: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(cls, component, cluster, block, straggler counts) of the classes of crowded regions that hold several components.

    Regions that share classes form a cluster. Blocks of classes outside the cluster's largest component come first.
    """
    if labels is None:
        known = crowded.withColumn("component", F.col("cls"))
    else:
        known = crowded.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    known = stage(known, "known")
    mixed = known.groupBy("region").agg(F.min("cls").alias("low"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n")).filter("c0 != c1").select("region", "low", "n")
    chained = stage(join_counted(known, stage(mixed, "mixed"), "region").filter("low is not null").select("cls", "component", "low"), "chained")
    forget(known)
    cluster = connected_components(chained, "cls", "low").withColumnRenamed("component", "cluster")
    return stage(chained.select("cls", "component").distinct().join(cluster, F.col("cls") == F.col("node")).select("cls", "component", "cluster"), "clusters")


def exact_links(clusters: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components of each cluster (cls, component, cluster), enough of them to connect what is linked."""
    held = clusters.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    most = held.groupBy("cluster").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.sum("n").alias("n"), F.max("n").alias("in_main"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = stage(most.select("cluster", "main", "n", blocks(F.col("n") - F.col("in_main")).alias("out"), blocks(F.col("in_main")).alias("inside")), "sizes")
    dealt = join_counted(clusters, sizes, "cluster")
    is_main = F.col("component") == F.col("main")
    dealt = dealt.withColumn("block", F.when(is_main, F.col("out") + F.pmod(F.xxhash64("cls"), F.col("inside").cast("long"))).otherwise(F.pmod(F.xxhash64("cls"), F.col("out").cast("long"))).cast("int"))
    others = F.when(is_main, F.sequence(F.lit(0), F.col("out") - 1)).otherwise(F.sequence(F.lit(0), F.col("out") + F.col("inside") - 1))
    met = dealt.withColumn("with", F.explode(others)).withColumn("bi", F.least("block", "with")).withColumn("bj", F.greatest("block", "with"))
    # small clusters go several to a task, so that tasks hold about what two blocks do
    small = F.col("n") <= BLOCK
    tasks = (sizes.filter(small).agg(F.sum("n").alias("n")).first()["n"] or 0) // BLOCK + 1
    part = F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(tasks))).otherwise(-1 - F.pmod(F.xxhash64("cluster", "bi", "bj"), F.lit(1 << 62)))
    rows = met.select("cls", "component", "cluster", "block", "bi", "bj", part.alias("part")).join(sets, "cls").join(classes, "cls").select("part", "cluster", "bi", "bj", "block", "cls", "component", "sig", "shingles")
    return rows.groupBy("part").applyInArrow(lambda t: _part_links(t, percent), "a bigint, b bigint")


def find_links(df: DataFrame, reps: DataFrame, key: str, text: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(links that the forest gives, links that the exact pass adds, (node, component) over both or None): all between classes."""
    classes = stage(reps.select("cls", "sig"), "class-signatures")
    pairs, crowded = candidates(classes)
    side = lambda n: classes.select(F.col("cls").alias(n), F.col("sig").alias(f"sig_{n}"))
    open_ = stage(_agreement(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")).filter(F.col("alike") >= FLOOR), "candidates")
    wanted = open_.select(F.col("a").alias("cls")).unionByName(open_.select(F.col("b").alias("cls"))).unionByName(crowded.select("cls")).distinct()
    carriers = reps.join(wanted, "cls", "left_semi").select("cls", "set_key", F.col("rep").alias("carrier"))
    texts = df.select(F.col(key).alias("carrier"), text).join(carriers.hint("shuffle_hash"), "carrier")
    sets = stage(shingle_sets(texts, text).dropDuplicates(["cls"]), "sets")

    set_of = lambda n: sets.select(F.col("cls").alias(n), F.col("shingles").alias(f"set_{n}"))
    links, labels = open_.select("a", "b").limit(0), None
    for turn in range(2):
        if row_count(open_) == 0:
            break
        chosen = open_.select("a", "b")
        if turn == 0:
            ends = open_.select("a", "b", "alike", F.explode(F.array("a", "b")).alias("end"))
            pair = F.struct("a", "b")
            picked = ends.groupBy("end").agg(F.max_by(pair, F.struct("alike", -F.col("a"), -F.col("b"))).alias("best"), F.min(pair).alias("low"))
            chosen = picked.select(F.explode(F.array("best", "low")).alias("p")).select("p.a", "p.b").distinct()
        checked = stage(_linked(chosen.join(set_of("a"), "a").join(set_of("b"), "b").select("a", "b", "set_a", "set_b"), percent), "checked")
        new = checked.filter("linked").select("a", "b")
        links = new if labels is None else links.unionByName(new)
        labels = stage(connected_components(links), "labels")
        if turn == 0:  # what lies within one component needs no check
            of = lambda n: labels.select(F.col("node").alias(n), F.col("component").alias(f"c_{n}"))  # noqa: B023, E731
            rest = open_.join(checked.select("a", "b"), ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
            again = stage(rest.filter(~F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False))).select("a", "b", "alike"), "candidates")
            forget(open_)
            open_ = again
    exact = None
    if row_count(crowded):
        clusters = open_regions(crowded, labels)
        if row_count(clusters):
            exact = stage(exact_links(clusters, classes, sets, percent), "exact")
            if row_count(exact):
                labels = stage(connected_components(links.unionByName(exact)), "labels")
        forget(clusters)
    forget(classes, sets, crowded)
    return links, exact if exact is not None else links.limit(0), labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of df; links are pairs of at least ``percent`` similarity."""
    written = stage(signatures(df, key, text), "signatures")
    signed = written.withColumnRenamed(key, "id")
    found = signed.filter("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"))
    reps = stage(found.withColumn("cls", F.monotonically_increasing_id()), "classes")  # written once, so the numbers hold
    _, _, labels = find_links(df, reps, key, text, percent)

    known = reps.select("set_key", "n", "cls", "rep")
    rows = join_counted(signed.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key")), known, "set_key")
    rows = stage(rows.select("id", "n_shingles", "cls", F.col("rep").alias("low")), "rows")
    forget(written)
    split = rows.filter("cls is not null").groupBy("id").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1")).filter("c0 != c1").select("id", "c0")
    if split.limit(1).collect():  # rows of one document that differ: their classes are linked through it
        through = rows.filter("cls is not null").join(split, "id").select(F.col("cls").alias("a"), F.col("c0").alias("b"))
        known_links = through if labels is None else through.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = stage(connected_components(known_links), "labels")
    if labels is not None:
        linked = stage(labels.join(known.select("cls", "rep", "n"), F.col("node") == F.col("cls")).select("component", "cls", "rep", "n"), "linked")
        lowest = stage(linked.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")), "lowest")
        of = join_counted(linked.select("cls", "component", F.col("n").alias("rows")), lowest, "component").select("cls", "least", F.col("rows").alias("n"))
        of = stage(of, "components")
        rows = join_counted(rows, of, "cls").withColumn("low", F.coalesce("least", "low"))
        forget(labels, linked, lowest)
    forget(reps)
    component = F.when(F.col("id").isNotNull(), F.coalesce("low", "id"))
    return rows.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
