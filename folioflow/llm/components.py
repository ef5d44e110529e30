"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _forest(batches):
    """Edges of one task as stars: the same components, at most one edge for each node. Bounded by ``held``."""
    held = 500_000
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def out():
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
            if len(parent) > held:
                yield out()
                parent.clear()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b long); comp is the component's smallest node.

    Each round is two aggregations with map-side minima, so a hub's edges never meet in one task; rounds are
    logarithmic in the longest chain, after each task has contracted what it holds. The edges are stars, and the work done, when
    every node has one edge down and none of these ends in a node that has an edge down itself.
    """
    edges = cut(edges.where("a <> b").mapInArrow(_forest, "a long, b long"))
    while not edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() or not edges.groupBy("a").count().where("count > 1").isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return cut(nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp")))
