"""Connected components of an edge table, without collecting edges or components.

Edges are first contracted inside each partition (union-find over the partition's edges), then large-star and
small-star steps run until nothing changes: every node ends up with an edge to the smallest node of its component.
Minima are pre-aggregated before the shuffle, and the joins back are plain equi-joins, so a node with very many
edges is handled by partial aggregation and skew-join splitting.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmend.llm.common import compact
from sparkmend.session import cut_lineage, release


def _contracted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one partition; an edge to the local root for each node."""
    root: dict = {}

    def find(x):
        path = []
        while root.get(x, x) != x:
            path.append(x)
            x = root[x]
        for p in path:
            root[p] = x
        return x

    for p in parts:
        for a, b in zip(p.a, p.b):
            x, y = find(bytes(a)), find(bytes(b))
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    if nodes:
        yield pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


PART_EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node of the component) for every node of ``edges`` (``a``, ``b``: binary) but the roots.

    Edges are dealt to as many partitions as hold ``PART_EDGES`` each; with one partition the contraction is all.
    """
    def local(e: DataFrame, parts: int) -> DataFrame:
        return e.where("a <> b").coalesce(parts).mapInPandas(_contracted, "a binary, b binary")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    now = cut_lineage(compact(edges), "edges")
    before = mark(now)
    while before[0]:
        parts = -(-before[0] // PART_EDGES)
        last = now
        if parts == 1:
            now = cut_lineage(local(now, 1), "edges")
            release(last)
            break
        now = cut_lineage(compact(_small_star(_large_star(local(now, parts)))), "edges")
        release(last)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
