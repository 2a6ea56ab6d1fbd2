"""Distributed union-find over an edge table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import discard, written

#: Nodes that one task's forest holds before it is given out and begun anew.
FOREST = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Union-find with path halving over one partition's edges; gives each node but the roots with its root.

    When the edges of a partition are many, the forest is given out and begun anew, so that memory stays bounded; the
    rounds that follow join such pieces like those of different partitions.
    """
    parent: dict = {}
    kind = None

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def out() -> pa.RecordBatch:
        nodes = [x for x in parent if parent[x] != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["a", "b"])

    for batch in batches:
        kind = batch.schema.types[0]
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > most:
            yield out()
            parent.clear()
    if parent:
        yield out()


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges with those of each partition contracted; the same components."""
    kind = edges.schema["a"].dataType.simpleString()
    kind = "long" if kind == "bigint" else kind
    return edges.mapInArrow(partial(_forest, most=FOREST), f"a {kind}, b {kind}")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "edges") -> DataFrame:
    """(node, root) for every node that an edge joins to another; root is its component's least node.

    Nodes are longs, or binaries if both columns are. Partitions contract their own edges by union-find, at first and
    after each round; large-star and small-star rounds (Kiveris et al. 2014), each written to the shared folder, join
    the pieces. Rounds grow with the logarithm of the nodes. Self-loops, repeated edges and edges with a null end add
    nothing; no edges give no rows.
    """
    kind = "binary" if edges.schema[a].dataType.simpleString() == edges.schema[b].dataType.simpleString() == "binary" else "long"
    edges = edges.select(F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")).filter("a <> b")
    edges = written(_contracted(edges).distinct(), name)
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        before, edges = edges, written(_contracted(small.distinct()), name)
        discard(before)
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
