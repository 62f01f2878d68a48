"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and joins over the edges; no node's neighbours
are gathered, so a hub splits like any other join key.  Rounds end when a round
changes nothing (O(log^2 n) of them).  A few edges (``FEW``) end in one task, which
holds no more than these.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import saved

#: Edges that one task contracts at once, and nodes that a task holds of the edges near it.
FEW = 1 << 14
HELD = 1 << 19


class _Forest(dict):
    """Node -> a smaller one of its component, or itself."""

    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def link(self, batch: pa.RecordBatch) -> None:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = self.find(a), self.find(b)
            self[max(a, b)] = min(a, b)

    def pairs(self, names: tuple[str, str]) -> pa.RecordBatch:
        """Every node with the least of its component."""
        found = [(x, self.find(x)) for x in list(self)]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], list(names))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b``: every node but the least of its component, with that one."""
    forest = _Forest()
    for batch in batches:
        forest.link(batch)
    out = forest.pairs(("a", "b"))
    yield out.filter(pc.not_equal(out["a"], out["b"]))


def _members(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """``node, root``: every node of the task's edges with the least that these connect
    it with; a node comes again if the task has met more than ``held`` nodes."""
    forest = _Forest()
    for batch in batches:
        forest.link(batch)
        if len(forest) > held:
            yield forest.pairs(("node", "root"))
            forest = _Forest()
    yield forest.pairs(("node", "root"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.join(least, "a").where("b > a and b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges go from the larger node ``a`` to the smaller ``b``."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for every node of ``edges`` (``a, b`` long)."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(
        edges.select(F.col("b").alias("node"))).distinct()
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                             F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    if 0 < state[0] <= FEW:
        now, state = saved(now.repartition(1).mapInArrow(_stars, "a long, b long"), "edges"), (0, None)
    while state[0]:
        now = saved(_small_star(_large_star(now)), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    return (nodes.join(now.select(F.col("a").alias("node"), "b"), "node", "left")
            .select("node", F.coalesce("b", "node").alias("component")))


def components_nearby(edges: DataFrame, held: int = HELD) -> DataFrame:
    """:func:`components` of edges whose partitions hold what lies close together: each
    partition is contracted where it is, and only nodes that several of them share link
    what is left."""
    members = saved(edges.mapInArrow(lambda it: _members(it, held), "node long, root long").distinct(), "members")
    least = members.groupBy("node").agg(F.min("root").alias("m"))
    links = members.join(least.hint("merge"), "node").where("root <> m").select(F.col("root").alias("a"), F.col("m").alias("b"))
    top = components(saved(links.distinct(), "shared")).select(F.col("node").alias("m"), "component")
    return least.join(top, "m", "left").select("node", F.coalesce("component", "m").alias("component"))
