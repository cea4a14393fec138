"""Connected components of a link table, without a hot task and without collecting links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.operators.skew import lookup_join
from lipika.session import drop_written, written

MAX_ROUNDS = 60
#: Links that a task contracts at once.
HELD = 1_000_000


def links_through(pairs: DataFrame, node: str, hub: str) -> DataFrame:
    """Links (a, b) that tie the nodes of each hub: a star around the hub's smallest node.

    ``n`` nodes under one hub give ``n - 1`` links, never all pairs. Null nodes
    and hubs tie nothing.
    """
    pairs = written(pairs.select(F.col(node).alias("node"), F.col(hub).alias("hub")).dropna().distinct(), "pairs")
    centre = pairs.groupBy("hub").agg(F.min("node").alias("centre"))
    return lookup_join(pairs, centre, ["hub"], "inner").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node id of the component of every node that has a link.

    Tasks of :data:`HELD` links each contract their links to stars by
    union-find; where one task holds them all, that is the result. While some
    node still hangs on several others or on one that is no root, alternating
    large-star and small-star rounds link every node to the smallest of its
    neighbourhood, so the depth shrinks geometrically. Neighbourhoods are only
    ever reduced to their minimum by partial aggregation; the join back runs
    hot nodes by broadcast. Every round is written to the shared folder, which
    cuts the lineage and survives lost executors. Self links, repeated links
    and nulls are ignored; no link gives no row.
    """
    now = written(links.dropna().where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        tasks = max(1, -(-now.count() // HELD))
        before, now = now, written(_contracted(now.coalesce(tasks)), "stars")
        drop_written(before)
        if tasks == 1 or _is_forest(now):
            break
        large = written(_large_star(now), "large")
        small = written(_small_star(large), "small")
        drop_written(now)
        drop_written(large)
        now = small
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _contracted(links: DataFrame) -> DataFrame:
    """Links (u, v), distinct: those of each task joined to stars around the smallest node."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up[p] if p in up else p
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(x, r) for x in list(up) if (r := find(x)) != x]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > 2 * HELD:  # more links than it was meant for: the stars of the rest are added to what went before
                yield stars()
        yield stars()

    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(contract, "u long, v long").distinct()


def _is_forest(links: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on another node."""
    n, nodes = links.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return n == nodes and links.select("u").join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood and itself."""
    both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("least")).select("x", F.least("x", "least").alias("least"))
    return lookup_join(both.where("y > x"), least, ["x"], "inner").select(F.col("y").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    moved = lookup_join(links, least, ["u"], "inner").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()
