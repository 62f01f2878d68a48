"""Ward's agglomeration (M17): a clustering-feature tree, then the
nearest-neighbour chain.

*Tree.*  A clustering feature is (rows, sum, sum of squares); features of two
sets add up to that of their union.  Points get a 62-bit code that halves the
bounding box dimension after dimension; a prefix of the code is a cell, and
cells form a binary tree.  Spark aggregates features by prefix (a plain
``groupBy``, merged map-side), so the order and the split of the rows do not
matter.  From the features of at most ``CELLS`` cells the driver adds up the
upper levels and splits the leaf with the largest sum of squared errors until
there are ``n_micro`` leaves; leaves that want to go below the cells read are
read again, deeper.  With no more distinct points than ``n_micro`` every point is
its own leaf and Ward is exact.

*Chain.*  From any cluster the chain follows nearest neighbours until two are
each other's; they merge.  Ward's criterion is reducible, so the merges are those
of the global minimum, found in another order: sorting by height gives the
dendrogram.  Time is quadratic in the leaves and memory linear.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import saved

#: Leaves that the chain agglomerates, and cells of one read of the tree.
MICRO = 4096
CELLS = 1 << 16
BITS = 62


# ---------------------------------------------------------------------------
# nearest-neighbour chain
# ---------------------------------------------------------------------------

def ward_merges(c: np.ndarray, w: np.ndarray) -> list[tuple]:
    """Ward agglomeration of weighted centroids.

    Rows ``(step, a, b, height, size)`` with the leaves 0..m-1 and merged clusters
    m, m+1, ...; the height is sqrt(2 D), D = w_a w_b / (w_a + w_b) |c_a - c_b|^2.
    """
    m = len(c)
    c, w = np.array(c, float), np.array(w, float)
    weights = w.tolist()
    alive = np.ones(m, bool)
    found, chain = [], []
    for _ in range(m - 1):
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            top = chain[-1]
            cost = w * w[top] / (w + w[top]) * ((c - c[top]) ** 2).sum(1)
            cost[~alive] = np.inf
            cost[top] = np.inf
            near = int(np.argmin(cost))
            # of equally near ones the one before wins, or the chain would not end
            if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
                near = chain[-2]
                break
            chain.append(near)
        del chain[-2:]
        keep, gone = min(top, near), max(top, near)
        total = w[keep] + w[gone]
        found.append((math.sqrt(2 * cost[near]), keep, gone))
        c[keep] = (c[keep] * w[keep] + c[gone] * w[gone]) / total
        w[keep] = total
        alive[gone] = False
    # the cluster that a slot held when it merged follows from the order of heights
    found.sort(key=lambda f: f[0])
    parent, name = list(range(m)), list(range(m))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, size = [], list(weights)
    for step, (height, a, b) in enumerate(found):
        a, b = root(a), root(b)
        parent[b] = a
        size.append(size[name[a]] + size[name[b]])
        out.append((step + 1, min(name[a], name[b]), max(name[a], name[b]), height, size[-1]))
        name[a] = m + step
    return out


def ward_cut(merges: list[tuple], m: int, k: int) -> np.ndarray:
    """Leaf -> cluster of the cut with ``k`` clusters (numbered by first leaf)."""
    parent = list(range(m + len(merges)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, a, b, *_ in merges[: m - k]:
        parent[root(a)] = parent[root(b)] = m + step - 1
    order: dict = {}
    return np.array([order.setdefault(root(i), len(order)) for i in range(m)])


# ---------------------------------------------------------------------------
# clustering-feature tree
# ---------------------------------------------------------------------------

def _codes(df: DataFrame, cols: list[str], low: np.ndarray, span: np.ndarray) -> DataFrame:
    """``df`` with ``_code``: the halvings of the bounding box, first one highest."""
    d = len(cols)
    depth = [(BITS - j + d - 1) // d for j in range(d)]       # halvings of each dimension

    @F.arrow_udf("long")
    def code(*values: pa.Array) -> pa.Array:
        out = np.zeros(len(values[0]), np.int64)
        for j, v in enumerate(values):
            x = (v.to_numpy(zero_copy_only=False) - low[j]) / (span[j] or 1.0)
            cell = np.clip((x * 2.0 ** depth[j]).astype(np.int64), 0, (1 << depth[j]) - 1)
            for t in range(depth[j]):
                bit = (cell >> (depth[j] - 1 - t)) & 1
                out |= bit << (BITS - 1 - (t * d + j))
        return pa.array(out)

    return df.withColumn("_code", code(*[F.col(f"`{c}`") for c in cols]))


class _Cell:
    """A node of the tree: its prefix (code of the first point below it, length),
    its feature, and its children once they are known."""

    __slots__ = ("start", "depth", "n", "s", "q", "children")

    def __init__(self, start, depth, n, s, q, children=()):
        self.start, self.depth, self.n, self.s, self.q, self.children = start, depth, n, s, q, children

    @property
    def error(self) -> float:
        return max(self.q - float(self.s @ self.s) / self.n, 0.0)


def _grow(cells: list[_Cell], top: int) -> list[_Cell]:
    """The nodes of depth ``top`` above ``cells``, which are sorted by code: a level
    adds up the features of the one below; an only child stands for its parent."""
    for depth in range(max((c.depth for c in cells), default=top) - 1, top - 1, -1):
        shift, level = BITS - depth, []
        for c in cells:
            start = c.start >> shift << shift
            if level and level[-1][0] == start:
                level[-1][1].append(c)
            else:
                level.append((start, [c]))
        cells = [kids[0] if len(kids) == 1 else
                 _Cell(start, depth, sum(k.n for k in kids), sum(k.s for k in kids), sum(k.q for k in kids), tuple(kids))
                 for start, kids in level]
    return cells


def _read(coded: DataFrame, cols: list[str], within: list[_Cell], cells: int) -> list[_Cell]:
    """For each node of ``within`` (sorted) the tree below it, down to the deepest
    level of which all of them together have at most ``cells`` cells."""
    starts = np.array([c.start for c in within], np.int64)
    ends = starts + np.array([1 << (BITS - c.depth) for c in within], np.int64)

    @F.arrow_udf("boolean")
    def inside(code: pa.Array) -> pa.Array:
        x = code.to_numpy()
        at = np.maximum(np.searchsorted(starts, x, side="right") - 1, 0)
        return pa.array((x >= starts[at]) & (x < ends[at]))

    rows = coded.where(inside("_code"))
    lowest = max(c.depth for c in within) + 1
    depths = sorted({min(BITS, lowest + s) for s in (0, 3, 6, 9, 12, 18, 24, 36, BITS)})
    # a sketch is one binary value; approx_count_distinct has hundreds of columns for each depth
    counts = rows.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.shiftright("_code", BITS - t), 13)).alias(str(t))
                        for t in depths]).first()
    fits = [t for t in depths if counts[str(t)] <= 0.9 * cells]
    # the first level has at most twice as many cells as there are nodes
    depth = max(fits) if fits else depths[0]
    cell = F.shiftleft(F.shiftright("_code", BITS - depth), BITS - depth)
    got = rows.groupBy(cell.alias("start")).agg(
        F.sum("_w").alias("n"), F.sum("_q").alias("q"),
        *[F.sum(F.col(f"`{c}`") * F.col("_w")).alias(f"s{i}") for i, c in enumerate(cols)]).toArrow().sort_by("start")
    at, sums = got["start"].to_numpy(), np.column_stack([got[f"s{i}"].to_numpy() for i in range(len(cols))])
    leaves = [_Cell(start, depth, float(n), s, q) for start, n, s, q in
              zip(at.tolist(), got["n"].to_numpy().tolist(), sums, got["q"].to_numpy().tolist())]
    return [_grow(leaves[lo:hi], c.depth)[0]
            for c, lo, hi in zip(within, np.searchsorted(at, starts), np.searchsorted(at, ends))]


def leaf_tree(df: DataFrame, cols: list[str], n_micro: int = MICRO, cells: int = CELLS, weight: str | None = None
              ) -> tuple[Callable[[DataFrame], DataFrame], np.ndarray, np.ndarray]:
    """(function that gives a table's rows the leaf number ``_micro`` of their
    coordinates, leaf centroids, leaf sizes).

    The tree is that of ``df``, a row of which counts ``weight`` times; the function
    takes any table whose coordinates are among those of ``df``.  Leaves are numbered
    in the order of their coordinates if every distinct point is a leaf, else of their
    codes.  Rows with a null coordinate are left out.
    """
    spark = df.sparkSession
    cols = list(cols)
    number = F.count(F.lit(1)) if weight is None else F.sum(F.col(f"`{weight}`")).cast("long")
    points = saved(df.dropna(subset=cols).groupBy(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
                   .agg(number.alias("_w")), "points")
    if points.limit(n_micro + 1).count() <= n_micro:
        rows = sorted(tuple(r) for r in points.collect())
        leaf = spark.createDataFrame([(*r[:-1], i) for i, r in enumerate(rows)],
                                     ", ".join(f"_l{j} double" for j in range(len(cols))) + ", _micro long")
        on = [F.col(f"`{c}`").cast("double") == F.col(f"_l{j}") for j, c in enumerate(cols)]

        def leaves_of(table: DataFrame) -> DataFrame:
            # at most n_micro rows
            return table.dropna(subset=cols).join(F.broadcast(leaf), on).drop(*[f"_l{j}" for j in range(len(cols))])

        x = np.array(rows, float).reshape(-1, len(cols) + 1)
        return leaves_of, x[:, :-1], x[:, -1]
    box = points.agg(*[F.min(c).alias(f"a{j}") for j, c in enumerate(cols)],
                     *[F.max(c).alias(f"b{j}") for j, c in enumerate(cols)]).first()
    low = np.array([box[f"a{j}"] for j in range(len(cols))])
    span = np.array([box[f"b{j}"] for j in range(len(cols))]) - low
    # squares about the box's middle keep the errors of far-off points exact
    mid = low + span / 2
    centred = points.select(*[(F.col(c) - float(mid[j])).alias(c) for j, c in enumerate(cols)], "_w")
    square = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)) * F.col("_w")
    coded = saved(_codes(centred, cols, low - mid, span).withColumn("_q", square), "codes")

    root = _read(coded, cols, [_Cell(0, 0, 1.0, np.zeros(len(cols)), 0.0)], cells)[0]
    heap, deeper = [(-root.error, root.start, root)], [root]
    while deeper:
        deeper = []
        while heap and len(heap) + len(deeper) < n_micro and heap[0][0] < 0:
            node = heapq.heappop(heap)[2]
            if node.children:
                for kid in node.children:
                    heapq.heappush(heap, (-kid.error, kid.start, kid))
            elif node.depth < BITS:
                deeper.append(node)
            else:
                heapq.heappush(heap, (0.0, node.start, node))
        if deeper:
            deeper.sort(key=lambda c: c.start)
            for node in _read(coded, cols, deeper, cells):
                heapq.heappush(heap, (-node.error, node.start, node))
    leaves = sorted((node for _, _, node in heap), key=lambda c: c.start)
    starts = np.array([c.start for c in leaves], np.int64)

    @F.arrow_udf("long")
    def leaf_of(code: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(starts, code.to_numpy(), side="right") - 1)

    def leaves_of(table: DataFrame) -> DataFrame:
        shifted = table.dropna(subset=cols).withColumns(
            {f"_m{j}": F.col(f"`{c}`").cast("double") - float(mid[j]) for j, c in enumerate(cols)})
        return (_codes(shifted, [f"_m{j}" for j in range(len(cols))], low - mid, span)
                .withColumn("_micro", leaf_of("_code")).drop("_code", *[f"_m{j}" for j in range(len(cols))]))

    return leaves_of, np.array([c.s / c.n for c in leaves]) + mid, np.array([c.n for c in leaves])


def micro_clusters(df: DataFrame, cols: list[str], n_micro: int = MICRO, cells: int = CELLS,
                   weight: str | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(``df`` with the leaf number ``_micro`` of every row, leaf centroids, leaf sizes);
    see :func:`leaf_tree`."""
    leaves_of, c, w = leaf_tree(df, cols, n_micro, cells, weight)
    return leaves_of(df), c, w


def ward_fit(df: DataFrame, cols: list[str], k_range, n_micro: int = MICRO, weight: str | None = None):
    """Ward over the tree's leaves: ``(function of :func:`leaf_tree`, {k: cluster of every
    leaf}, merges, leaves)``; a k beyond the leaves is left out."""
    leaves_of, c, w = leaf_tree(df, list(cols), n_micro, weight=weight)
    merges = ward_merges(c, w)
    return leaves_of, {k: ward_cut(merges, len(c), k) for k in k_range if k <= len(c)}, merges, len(c)


def leaf_label(cut: np.ndarray) -> Column:
    """The cluster of a row's leaf ``_micro``."""
    cut = np.asarray(cut, np.int64)

    @F.arrow_udf("long")
    def label(leaf: pa.Array) -> pa.Array:
        return pa.array(cut[leaf.to_numpy()])

    return label("_micro")


def ward_micro(df: DataFrame, cols: list[str], k_range, n_micro: int = MICRO, id_col: str = "row_id"):
    """Ward for every k (M17): ``(labels (k, id, cluster), merges, leaves used)``."""
    spark = df.sparkSession
    rows = df.select(id_col, *cols)
    leaves_of, cuts, merges, m = ward_fit(rows, list(cols), k_range, n_micro)
    assigned = saved(leaves_of(rows).select(id_col, "_micro"), "micro")
    table = spark.createDataFrame([(i, k, int(c)) for k, cut in cuts.items() for i, c in enumerate(cut)],
                                  "_micro long, k int, cluster long")
    # n_micro rows per k
    labels = assigned.join(F.broadcast(table), "_micro").select("k", id_col, "cluster")
    return labels, spark.createDataFrame(merges, "step int, a long, b long, height double, size double"), m
