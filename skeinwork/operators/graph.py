"""Graph operators. Iterations end in a table or checkpoint, so plans stay short and survive lost executors."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

DAMPING, ROUNDS, ABSENT = 0.85, 20, 0.0001
FEW = 1 << 19


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(id, rank) after a fixed number of rounds; nodes (id), edges (src, dst) taken once each.

    Rank starts at 1/N. Sinks keep what they get; a source that is no node gives its start share each round. The links
    stay partitioned by source, so a round is one join in place and one aggregation; ranks are written every five rounds.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(None).cast("double").alias("rank"))
    edges = stage(edges.select("src", "dst").distinct(), "edges")
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = stage(edges.join(out, "src").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"), "links")
    ranks = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    if not edges.limit(1).collect():
        return ranks
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = links.repartition(parts, "src").persist()
    base = nodes.select("id", F.lit(0.0).alias("part"))
    for i in range(rounds):
        given = links.join(ranks, F.col("src") == F.col("id"), "left").select(F.col("dst").alias("id"), (F.coalesce("rank", F.lit(1.0 / n)) / F.col("out")).alias("part"))
        ranks = given.unionByName(base).groupBy("id").agg(((1 - damping) / n + damping * F.sum("part")).alias("rank"))
        if i % 5 == 4 or i == rounds - 1:
            ranks = stage(ranks, "ranks")
    links.unpersist()
    return ranks


def within_hops(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(id, hops) of what (id) reaches over (src, dst) within ``depth`` hops, itself at 0: frontier joins with an anti-join on what was met."""
    met = front = start.select("id", F.lit(0).alias("hops"))
    for h in range(1, depth + 1):
        front = edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(met, "id", "left_anti").select("id", F.lit(h).alias("hops"))
        met = met.unionByName(front)
    return met


def _cycles_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, victim) of one task's edges (src, dst): strongly connected components by two sweeps of depth-first search."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ahead: dict = defaultdict(list)
    back: dict = defaultdict(list)
    for a, b in zip(table["src"].to_pylist(), table["dst"].to_pylist(), strict=True):
        ahead[a].append(b)
        back[b].append(a)
    order, seen = [], set()
    for root in [*ahead]:
        if root in seen:
            continue
        seen.add(root)
        path = [(root, iter(ahead[root]))]
        while path:
            node, rest = path[-1]
            for other in rest:
                if other not in seen:
                    seen.add(other)
                    path.append((other, iter(ahead.get(other, ()))))
                    break
            else:
                order.append(node)
                path.pop()
    ids, victims, taken = [], [], set()
    for root in reversed(order):
        if root in taken:
            continue
        taken.add(root)
        part = [root]
        for node in part:
            for other in back.get(node, ()):
                if other not in taken:
                    taken.add(other)
                    part.append(other)
        if len(part) > 1:
            ids += part
            victims += [max(part)] * len(part)
    kind = table["src"].type
    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(victims, kind)], names=["id", "victim"])


def on_cycles(edges: DataFrame) -> DataFrame:
    """(id, victim) of the nodes that lie on a cycle, with the greatest node of those they share cycles with; self-edges don't count.

    Leaves are peeled off until only cores are left. Then every node takes the greatest node that reaches it as its colour;
    what reaches a colour's own node backwards within the colour is one strongly connected component. Those go, and the
    rest is coloured again. Only one value a node moves, never the pairs of a closure. A core of at most FEW edges, which
    fits one task whatever the graph, is settled there.
    """
    spark = edges.sparkSession
    core = stage(edges.filter("src != dst").select("src", "dst").distinct(), "core")
    found = None
    while True:
        size = core.count()
        while size:
            trimmed = core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            core = stage(trimmed.select("src", "dst"), "core")
            left = core.count()
            if left == size:
                break
            size = left
        if not size:
            break
        if size <= FEW:
            kinds = f"id {dict(core.dtypes)['src']}, victim {dict(core.dtypes)['src']}"
            part = core.coalesce(1).mapInArrow(_cycles_in, kinds)
            return part if found is None else found.unionByName(part)
        colour = stage(core.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("c")), "colour")
        while True:
            sent = core.join(colour.select(F.col("id").alias("src"), "c"), "src").select(F.col("dst").alias("id"), "c")
            new = stage(sent.unionByName(colour).groupBy("id").agg(F.max("c").alias("c")), "colour")
            changed = new.join(colour.withColumnRenamed("c", "was"), "id").filter("c != was").limit(1).collect()
            colour = new
            if not changed:
                break
        inside = core.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst")
        inside = stage(inside, "inside")
        front = met = stage(colour.filter("id = c"), "met")
        while front.limit(1).collect():
            back = inside.join(front.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct()
            front = stage(back.join(met, "id", "left_anti"), "front")
            met = stage(met.unionByName(front), "met")
        many = met.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c")
        part = met.join(many, "c", "left_semi").select("id", F.col("c").alias("victim"))
        found = part if found is None else found.unionByName(part)
        gone = met.select(F.col("id").alias("gone"))
        core = stage(core.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti"), "core")
    return found if found is not None else spark.createDataFrame([], f"id {dict(edges.dtypes)['src']}, victim {dict(edges.dtypes)['src']}")


def opic_round(cash: DataFrame, links: DataFrame) -> DataFrame:
    """(url, cash, history): every page of (url, cash, history) hands its cash to its out-links (url, target), repeats included."""
    out = links.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    share = cash.join(out, "url").select(F.col("url").alias("from"), (F.col("cash") / F.col("n")).alias("part"))
    gain = links.join(share, F.col("url") == F.col("from")).groupBy(F.col("target").alias("t")).agg(F.sum("part").alias("gain"))
    done = cash.join(gain, F.col("url") == F.col("t"), "full_outer")
    # a URL first met as a target starts with 1 and isn't visited in this round
    return done.select(F.coalesce("url", "t").alias("url"), F.when(F.col("url").isNotNull(), F.coalesce("gain", F.lit(0.0))).otherwise(1.0 + F.col("gain")).alias("cash"), (F.coalesce("history", F.lit(0.0)) + F.coalesce("cash", F.lit(0.0))).alias("history"))
