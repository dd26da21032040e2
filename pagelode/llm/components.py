"""Distributed connected components by alternating large-star and small-star steps.

Each step joins the edges with the least neighbour of each node. Beyond a few million edges the least neighbours are
written to the shared folder first, so that both sides of the join are plain exchanges and a hub with a large share of
the edges can be split by adaptive execution. The number of rounds grows with the logarithm of the longest chain.
Unless only DataFrame operations are asked for, each round begins by replacing the edges of every file by a spanning
forest of stars; where all edges fit in one file, that is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.scratch import ROWS_PER_FILE, materialize

MOST_ROUNDS = 60
#: Edges up to which a hub is no burden for one task.
SMALL = 4_000_000


def connected_components(edges: DataFrame, native: bool = False) -> DataFrame:
    """(node, component) of the undirected edges (a, b): component is the least node that can be reached.

    Nulls and self-loops are no edges; repeated edges count once. No edges: no rows. native: DataFrame operations only.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.where("a is not null and b is not null and a <> b").distinct(), "edges")
    last = _digest(edges)
    if not last[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if not native and last[0] <= ROWS_PER_FILE:
        return _with_roots(materialize(edges.coalesce(1).mapInArrow(_forest, edges.schema), "edges"))
    for _ in range(MOST_ROUNDS):
        if not native:
            edges = materialize(edges.mapInArrow(_forest, edges.schema), "edges")
        edges = materialize(_small_star(materialize(_large_star(edges, last[0]), "edges", last[0]), last[0]), "edges", last[0])
        now = _digest(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    return _with_roots(edges)


def _with_roots(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each node of these edges but the least of its set, and that least one."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    kind = None
    for batch in batches:
        kind = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    told = [(x, root(x)) for x in list(parent)]
    told = [(x, y) for x, y in told if x != y]
    if told:
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], kind.field(k).type) for k in range(2)], names=["a", "b"])


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _told(least: DataFrame, count: int) -> DataFrame:
    """The least neighbours, written first where a hub could outgrow a task."""
    return materialize(least, "least", 2 * count) if count > SMALL else least


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _told(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), count)
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = _told(edges.groupBy("a").agg(F.min("b").alias("m")), count)
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
