"""Segmentation operators.

* k-means (``kmeans``) and Ward (``ward``) are imported here.
* DBSCAN: ε-neighbourhoods by boxes of side 2ε whose points meet, a bounded number
  at a time, in one group each; core points that cell counts show compare nothing.  Connectivity runs on a finer grid: adjacent core cells
  link without pair tests, boundary cells are first compared by sub-cells, and
  components come from star contraction until nothing changes.  Several (ε,
  minPts) settings share every pass.
* k-prototypes: all starts of all k iterate together, as k-means.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import components, components_nearby
from tessera.operators.kmeans import centre_label, kmeans_fit, kmeans_sweep  # noqa: F401
from tessera.operators.validate import SEED, md5_sample
from tessera.operators.ward import leaf_label, ward_cut, ward_fit, ward_merges, ward_micro  # noqa: F401
from tessera.session import ensure_checkpoint_dir
from tessera.sources.scratch import saved, small

#: Points of one box that one group compares with as many others; larger boxes are split.
CELL_POINTS = 8192


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# ---------------------------------------------------------------------------
# ε-neighbourhoods on a grid (J7) and DBSCAN
# ---------------------------------------------------------------------------

#: Grid sides in units of ε are shrunk by this, so that a cell's diagonal is below ε.
_INSIDE = 1.0 - 1e-9


def _offsets(d: int, side: float):
    """Neighbour-cell offsets for cells of ``side`` (in ε), split into 'full'
    (every pair within ε) and 'partial'."""
    r = int(math.ceil(1.0 / side)) + 1
    full, partial = [], []
    for o in itertools.product(range(-r, r + 1), repeat=d):
        mind = side * math.sqrt(sum(max(abs(x) - 1, 0) ** 2 for x in o))
        maxd = side * math.sqrt(sum((abs(x) + 1) ** 2 for x in o))
        if mind > 1.0:
            continue
        (full if maxd <= 1.0 else partial).append(o)
    return full, partial


def _half(offsets):
    """One of every offset and its opposite: either finds the same pairs of cells."""
    return [o for o in offsets if o > (0,) * len(o)]


def _offset_array(offsets):
    return F.array(*[F.array(*[F.lit(x) for x in o]) for o in offsets])


def _shift(cell: str, offset: str) -> Column:
    return F.zip_with(cell, offset, lambda a, b: a + b)


def _cell(cols: list[str], side: Column) -> Column:
    return F.array(*[F.floor(_q(c) / side).cast("long") for c in cols])


def _close(d: int, eps: Column) -> Column:
    return F.sqrt(sum(((F.col(f"_a{i}") - F.col(f"_b{i}")) ** 2 for i in range(d)), F.lit(0.0))) <= eps


def _named(df: DataFrame, cols: list[str], prefix: str, *keep) -> DataFrame:
    return df.select(*keep, *[_q(c).alias(f"_{prefix}{i}") for i, c in enumerate(cols)])


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` to be joined by a shuffle: Spark takes an exploded table for as small as
    the one before, and would hand all its rows to the driver to broadcast them."""
    return df.hint("merge")


def _within(homes: DataFrame, others: DataFrame, cols: list[str], value: str, least: bool = False) -> DataFrame:
    """``_s, coordinates, _found``: sum (or ``least``) of the ``value`` (long) of the
    ``others`` within ε of every one of the ``homes``; 0 (null) where none is.

    Both have ``_s, _eps, coordinates``, homes distinct ones.  Space is cut into
    boxes of side 2ε; a box's homes meet the others within ε of the box, at most
    ``CELL_POINTS`` of either in one group, so that a point is repeated a few times
    and neither a pair nor a neighbour cell is ever a row.  A group compares the
    homes of one small cell with the others within ε of the cell.
    """
    d, none = len(cols), np.iinfo(np.int64).max
    side = 2.0 * F.col("_eps")
    reach = F.col("_eps") * (1.0 + 1e-9)
    home = homes.select("_s", "_eps", *[_q(c) for c in cols], F.lit(None).cast("long").alias("_v"),
                        *[F.floor(_q(c) / side).cast("long").alias(f"_x{i}") for i, c in enumerate(cols)])
    other = others.select("_s", "_eps", *[_q(c) for c in cols], F.col(value).cast("long").alias("_v"))
    for i, c in enumerate(cols):
        lo, hi = (F.floor(x / side).cast("long") for x in (_q(c) - reach, _q(c) + reach))
        other = other.withColumn(f"_x{i}", F.explode(F.sequence(lo, hi)))
    box = ["_s", *[f"_x{i}" for i in range(d)]]
    sizes = home.groupBy(*box).agg(F.ceil(F.count(F.lit(1)) / CELL_POINTS).cast("int").alias("_hn")).join(
        _dealt(other.groupBy(*box).agg(F.ceil(F.count(F.lit(1)) / CELL_POINTS).cast("int").alias("_on"))), box)
    sizes = _dealt(saved(sizes, "boxes"))

    def parts(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def part(n):
        return F.pmod(F.xxhash64(*[_q(c) for c in cols]), n).cast("int")

    left = home.join(sizes, box).withColumn("_h", part("_hn")).withColumn("_o", parts("_on"))
    right = other.join(sizes, box).withColumn("_o", part("_on")).withColumn("_h", parts("_hn"))
    keys = [*box, "_h", "_o"]

    def meet(table: pa.Table) -> pa.Table:
        x = np.column_stack([table[c].to_numpy() for c in cols])
        eps, s = table["_eps"][0].as_py(), table["_s"][0].as_py()
        mine = table["_v"].is_null().to_numpy()
        v, y, x = table["_v"].filter(pa.array(~mine)).to_numpy(), x[~mine], x[mine]
        cell = np.floor(x / (eps / math.sqrt(d)))
        order = np.lexsort(cell.T)
        x, cell = x[order], cell[order]
        found = np.full(len(x), none if least else 0, np.int64)
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)]) if len(x) else []
        for lo, hi in zip(starts, [*starts[1:], len(x)]):
            at = x[lo:hi]
            near = np.flatnonzero(((y >= at.min(0) - eps * (1.0 + 1e-9)) & (y <= at.max(0) + eps * (1.0 + 1e-9))).all(1))
            to, w = y[near], v[near]
            for i in range(lo, hi, 512):
                a = x[i:min(i + 512, hi)]
                d2 = np.zeros((len(a), len(to)))
                for j in range(d):
                    step = a[:, j, None] - to[:, j]
                    d2 += step * step
                close = np.sqrt(d2) <= eps
                if least:
                    found[i:i + len(a)] = np.where(close, w, none).min(1, initial=none)
                else:
                    found[i:i + len(a)] = np.where(close, w, 0).sum(1)
        return pa.table({"_s": pa.array(np.full(len(x), s), pa.int32()),
                         **{f"_c{j}": pa.array(x[:, j]) for j in range(d)},
                         "_found": pa.array(found, mask=found == none if least else None)})

    got = left.select(*keys, "_eps", *cols, "_v").unionByName(right.select(*keys, "_eps", *cols, "_v")).groupBy(*keys).applyInArrow(
        meet, "_s int, " + "".join(f"_c{j} double, " for j in range(d)) + "_found long")
    agg = F.min if least else F.sum
    return got.groupBy("_s", *[F.col(f"_c{j}").alias(c) for j, c in enumerate(cols)]).agg(agg("_found").alias("_found"))


def _neighbor_counts(pts: DataFrame, cols: list[str], at_least: Column | None = None) -> DataFrame:
    """``_s, coordinates, n``: points within ε of every distinct point of a setting.

    ``pts``: ``_s, _eps, coordinates, _m`` (multiplicity).  With ``at_least`` only
    points whose cell counts do not reach it compare points; the others keep the
    count of the cells, which already suffices.
    """
    pts = saved(pts, "distinct")
    if at_least is None:
        return _within(pts, pts, cols, "_m").withColumnRenamed("_found", "n")
    d = len(cols)
    side = 1.0 / math.sqrt(d) * _INSIDE
    full, _ = _offsets(d, side)
    key = ["_s", "_cell"]
    u = pts.withColumn("_cell", _cell(cols, F.col("_eps") * side))
    cells = u.groupBy(*key).agg(F.sum("_m").alias("_cn"))
    near = (cells.select("_s", F.col("_cell").alias("_src"), "_cn", F.explode(_offset_array(full)).alias("_o"))
            .select("_s", F.zip_with("_src", "_o", lambda a, b: a - b).alias("_cell"), "_cn")
            .groupBy(*key).agg(F.sum("_cn").alias("_full")))
    u = saved(u.join(_dealt(near), key).drop("_cell"), "neighbours")
    found = _within(u.where(F.col("_full") < at_least), u, cols, "_m")
    return u.join(_dealt(found), ["_s", *cols], "left").withColumn("n", F.coalesce("_found", "_full")).drop("_full", "_found")


def _settings(df: DataFrame, cols: list[str], settings: list[tuple[float, int]], id_col: str, *keep: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("_s"), F.lit(float(e)).alias("_eps"), F.lit(int(m)).alias("_mp"))
                     for i, (e, m) in enumerate(settings)])
    base = df.select(id_col, *[_q(c).cast("double").alias(c) for c in cols], *keep)
    return base.select(id_col, *cols, *keep, F.explode(rows).alias("_x")).select(id_col, *cols, *keep, "_x.*")


def eps_neighbor_counts(df: DataFrame, cols: list[str], eps: float, id_col: str = "row_id") -> DataFrame:
    """Number of points within ε of every point, itself included.

    ``(id, n_neighbors)``.  Exact; distinct coordinates are compared by boxes
    (:func:`_within`).
    """
    ensure_checkpoint_dir(df.sparkSession)
    base = _settings(df, cols, [(eps, 0)], id_col)
    pts = base.groupBy("_s", "_eps", *cols).agg(F.count(F.lit(1)).alias("_m"))
    n = _neighbor_counts(pts, cols).select("_s", *cols, F.col("n").alias("n_neighbors"))
    return base.join(_dealt(n), ["_s", *cols]).select(id_col, "n_neighbors")


#: Cells along a side of the block whose links come to one task.
NEAR = 16
#: Pairs of sub-cells with at most this many pairs of points compare the points.
PAIR_POINTS = 256
#: Halvings of a cell's side; below, coordinates differ by less than 1e-9 of ε.
SPLITS = 28


def _mixed(cells: DataFrame, d: int) -> DataFrame:
    """The cells (``_s, _cell, component``) with a cell of another component within
    reach, by a grid so coarse that all points within ε lie in adjacent cells."""
    times = int(math.ceil(2.0 * math.sqrt(d) / _INSIDE))
    coarse = F.transform("_cell", lambda v: F.floor(v / times).cast("long"))
    named = cells.withColumn("_coarse", coarse)
    around = _offset_array(list(itertools.product((-1, 0, 1), repeat=d)))
    ends = named.groupBy("_s", "_coarse").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = (ends.select("_s", "_coarse", "lo", "hi", F.explode(around).alias("_o"))
             .groupBy("_s", _shift("_coarse", "_o").alias("_coarse")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
             .where("lo <> hi").select("_s", "_coarse"))
    return saved(named.join(_dealt(mixed), ["_s", "_coarse"], "left_semi").drop("_coarse"), "mixed")


def _links(cand: DataFrame, core: DataFrame, cols: list[str]) -> DataFrame:
    """Which pairs of components (``_s, _la, _lb``) hold two core points within ε in one
    of their candidate cell pairs (``_s, _eps, _a, _b, _la, _lb``).

    A closest-pair search for all pairs at once, by recursive splitting: pairs of
    sub-cells that are wholly apart are dropped; components are linked by
    sub-cells wholly within ε or by their representatives (one point each); few
    points are compared directly; what is left halves its sides.  All pairs of
    linked components end there.  Dense walls that face each other thus split
    along the wall and are settled by representatives or by distance, and no task
    joins all points of two sub-cells.
    """
    d = len(cols)
    side = 1.0 / (2.0 * math.sqrt(d)) * _INSIDE
    wanted = cand.select("_s", F.col("_a").alias("_cell")).unionByName(
        cand.select("_s", F.col("_b").alias("_cell"))).distinct()
    pts = saved(core.join(_dealt(wanted), ["_s", "_cell"]), "boundary")
    point = F.array(*[_q(c) for c in cols])

    def parts(level):
        """Sub-cells of a level: count and one point of each."""
        sub = _cell(cols, F.col("_eps") * (side / 2 ** level))
        return pts.groupBy("_s", "_eps", "_cell", sub.alias("_sub")).agg(
            F.count(F.lit(1)).alias("_n"), F.min(point).alias("_p"))

    def half(sub):
        return F.transform(sub, lambda v: F.floor(v / 2).cast("long"))

    def sides(t, x):
        return t.select("_s", *[F.col(c).alias(f"{c}{x}") for c in ("_cell", "_sub", "_n", "_p")])

    def length(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, y: total + y * y))

    open_, linked = None, []
    for level in range(0, SPLITS + 1):
        now = saved(parts(level), "subcells")
        a, b = sides(now, "_a"), sides(now, "_b")
        if open_ is None:
            pairs = cand.select("_s", "_eps", "_la", "_lb", F.col("_a").alias("_cell_a"), F.col("_b").alias("_cell_b"))
            pairs = pairs.join(_dealt(a), ["_s", "_cell_a"]).join(_dealt(b), ["_s", "_cell_b"])
        else:
            up = ["_s", "_cell_a", "_up_a", "_cell_b", "_up_b"]
            pairs = (open_.join(_dealt(a.withColumn("_up_a", half("_sub_a"))), ["_s", "_cell_a", "_up_a"])
                     .join(_dealt(b.withColumn("_up_b", half("_sub_b"))), ["_s", "_cell_b", "_up_b"]).drop(*up[2::2]))
        apart = F.zip_with("_sub_a", "_sub_b", lambda x, y: F.abs(x - y).cast("double"))
        size = side / 2 ** level
        near = size * length(F.transform(apart, lambda v: F.greatest(v - 1, F.lit(0.0))))
        far = size * length(F.transform(apart, lambda v: v + 1))
        exact = length(F.zip_with("_p_a", "_p_b", lambda x, y: x - y)) <= F.col("_eps")
        pairs = saved(pairs.withColumn("_far", far).withColumn("_near", near).withColumn(
            "_hit", (F.col("_far") <= 1.0) | exact).where("_hit or _near <= 1.0 + 1e-12"), "pairs")
        key = ["_s", "_la", "_lb"]
        hits = pairs.where("_hit").select(*key).distinct()
        rest = pairs.where("not _hit").join(hits, key, "left_anti")
        few = (F.col("_n_a") * F.col("_n_b") <= PAIR_POINTS) | F.lit(level == SPLITS)
        tiny = rest.where(few)
        left = _named(pts.withColumn("_sub", _cell(cols, F.col("_eps") * size)), cols, "a", "_s", F.col("_cell").alias("_cell_a"),
                      F.col("_sub").alias("_sub_a"))
        right = _named(pts.withColumn("_sub", _cell(cols, F.col("_eps") * size)), cols, "b", "_s", F.col("_cell").alias("_cell_b"),
                       F.col("_sub").alias("_sub_b"))
        found = (tiny.join(_dealt(left), ["_s", "_cell_a", "_sub_a"]).join(_dealt(right), ["_s", "_cell_b", "_sub_b"])
                 .where(_close(d, F.col("_eps"))).select(*key).distinct())
        done = saved(hits.unionByName(found).distinct(), "linked")
        linked.append(done)
        open_ = saved(rest.where(~few).join(done, key, "left_anti").select(
            *key, "_eps", "_cell_a", F.col("_sub_a").alias("_up_a"), "_cell_b", F.col("_sub_b").alias("_up_b")), "open")
        if open_.isEmpty():
            break
    out = linked[0]
    for t in linked[1:]:
        out = out.unionByName(t)
    return saved(out.distinct(), "linked")


def dbscan_settings(df: DataFrame, cols: list[str], settings: list[tuple[float, int]],
                    id_col: str = "row_id", weight: str | None = None) -> DataFrame:
    """DBSCAN for several (ε, minPts) at once: ``(eps, min_pts, id, cluster)``, noise = −1.

    A row counts as ``weight`` points.

    * Core test on a grid of side ε/√d: a point whose own cell plus the fully
      covered neighbour cells already hold ``min_pts`` points is core from
      cell counts alone; only the remaining (sparse-region) points compare
      against boundary cells.
    * Connectivity on a grid of side ε/(2√d): core cells linked through 'full'
      offsets form components without any pair test; cell pairs at boundary
      offsets are compared only while their components differ.  Components
      contract until nothing changes, however long a chain is.
    * Border points take the smallest label of a core point within ε.
    Clusters are numbered by their smallest core id (discovery order of a scan
    by id).  Ids are whole numbers.
    """
    from tessera.operators.ranks import rank_histogram

    ensure_checkpoint_dir(df.sparkSession)
    d, n_set = len(cols), len(settings)
    base = saved(_settings(df, cols, settings, id_col), "points")
    # neighbours are counted once for each ε, up to the largest minPts
    radii = sorted({e for e, _ in settings})
    most = max(m for _, m in settings)
    counted = _settings(df, cols, [(e, most) for e in radii], id_col, *([weight] if weight else []))
    number = F.sum(F.col(weight)).cast("long") if weight else F.count(F.lit(1))
    pts = counted.groupBy("_s", "_eps", *cols).agg(number.alias("_m"))
    counts = _neighbor_counts(pts, cols, F.lit(most)).select("_eps", *cols, "n")
    marks = F.array(*[F.struct(F.lit(i).alias("_s"), F.lit(float(e)).alias("_e"), F.lit(int(m)).alias("_k"))
                      for i, (e, m) in enumerate(settings)])
    coords = saved(counts.select("_eps", *cols, "n", F.explode(marks).alias("_x")).where("_x._e = _eps")
                   .select("_x._s", *cols, (F.col("n") >= F.col("_x._k")).alias("_core")), "core")

    side = 1.0 / (2.0 * math.sqrt(d)) * _INSIDE
    full, partial = _offsets(d, side)
    here = saved(base.join(_dealt(coords), ["_s", *cols]).withColumn("_cell", _cell(cols, F.col("_eps") * side)), "cells")
    core = here.where("_core")
    # a node of the graph is a core cell, named by its smallest id and the setting
    node = F.min(id_col) * n_set + F.col("_s")
    cells = saved(core.groupBy("_s", "_eps", "_cell").agg(node.alias("_node")), "nodes")
    to = cells.select("_s", F.col("_cell").alias("_b"), F.col("_node").alias("b"))
    # every cell is linked to itself; cells close together come to one task
    edges = (cells.select("_s", F.col("_node").alias("a"), F.col("_cell").alias("_a"),
                          F.explode(_offset_array([(0,) * d, *_half(full)])).alias("_o"))
             .select("_s", "a", "_a", _shift("_a", "_o").alias("_b")).join(_dealt(to), ["_s", "_b"])
             .repartition("_s", F.transform("_a", lambda v: F.floor(v / NEAR).cast("long"))).select("a", "b"))
    comp = saved(components_nearby(edges), "components")
    if partial:
        at = saved(cells.join(comp.withColumnRenamed("node", "_node"), "_node"), "labels")
        near = _mixed(at, d)
        other = near.select("_s", F.col("_cell").alias("_b"), F.col("component").alias("_lb"))
        met = (near.select("_s", "_eps", F.col("_cell").alias("_a"), F.col("component").alias("_la"),
                           F.explode(_offset_array(_half(partial))).alias("_o"))
               .withColumn("_b", _shift("_a", "_o")).join(_dealt(other), ["_s", "_b"]).where("_la <> _lb"))
        up = F.col("_la") < F.col("_lb")
        cand = saved(met.select("_s", "_eps", *[F.when(up, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in
                                                (("_a", "_b"), ("_b", "_a"), ("_la", "_lb"), ("_lb", "_la"))]), "candidates")
        uniq = core.select("_s", "_eps", "_cell", *cols).distinct()
        more = _links(cand, uniq, cols).select(F.col("_la").alias("a"), F.col("_lb").alias("b"))
        merged = saved(components(more).select(F.col("node").alias("component"), F.col("component").alias("_top")), "merged")
        comp = comp.join(merged, "component", "left").select("node", F.coalesce("_top", "component").alias("component"))
    lab = saved(cells.join(comp.withColumnRenamed("node", "_node"), "_node")
                .select("_s", "_cell", F.col("component").alias("_lab")), "labels")
    core_lab = core.join(_dealt(lab), ["_s", "_cell"]).select("_s", "_eps", id_col, *cols, "_lab")

    border = here.where(~F.col("_core"))
    target = saved(core_lab.groupBy("_s", "_eps", *cols).agg(F.min("_lab").alias("_lab")), "targets")
    inner = _within(saved(border.select("_s", "_eps", *cols).distinct(), "border"), target, cols, "_lab", least=True)
    inner = border.join(_dealt(inner.where("_found is not null")), ["_s", *cols]).select("_s", id_col, F.col("_found").alias("_lab"))
    labeled = saved(core_lab.select("_s", id_col, "_lab").unionByName(inner).groupBy("_s", id_col).agg(
        F.min("_lab").alias("_lab")), "labeled")
    # number the clusters 0..k-1 by their smallest core id with the distributed
    # rank (the number of clusters grows with the data: no single-task window)
    known = lab.select("_s", "_lab").distinct().select("_s", "_lab", F.lit(1).cast("long").alias("cnt"))
    names = rank_histogram(known, ["_s"], "_lab").select("_s", "_lab", F.col("before").alias("cluster"))
    out = base.select("_s", "_eps", "_mp", id_col).join(_dealt(labeled), ["_s", id_col], "left").join(
        names, ["_s", "_lab"], "left")
    return out.select(F.col("_eps").alias("eps"), F.col("_mp").alias("min_pts"), id_col,
                      F.coalesce(F.col("cluster"), F.lit(-1)).cast("long").alias("cluster"))


def dbscan(df: DataFrame, cols: list[str], eps: float, min_pts: int, id_col: str = "row_id") -> DataFrame:
    """DBSCAN labels ``(id, cluster)`` with noise = −1 (M19); see :func:`dbscan_settings`."""
    return dbscan_settings(df, cols, [(eps, min_pts)], id_col).select(id_col, "cluster")


# ---------------------------------------------------------------------------
# k-prototypes
# ---------------------------------------------------------------------------

def _hashes(df: DataFrame, values: list[str]) -> list[int]:
    """Spark's hashes of category names."""
    one = df.sparkSession.range(1).select(*[F.xxhash64(F.lit(v)).alias(f"h{i}") for i, v in enumerate(values)])
    return list(one.first())


def _dense_rows(base: DataFrame, cat_cols: list[str], id_col: str, k: int) -> list:
    """``k`` starting rows by category density: the first has the most frequent
    categories, each further one the largest density times distance to the
    nearest row chosen so far (ties: smaller id)."""
    n = base.count()
    freq = {}
    for c in cat_cols:
        freq[c] = saved(base.groupBy(F.col(c).alias(f"_f_{c}")).agg((F.count(F.lit(1)) / n).alias(f"_n_{c}")), "freq")
    rows = base
    for c in cat_cols:
        rows = rows.join(small(freq[c]), F.col(c).eqNullSafe(F.col(f"_f_{c}"))).drop(f"_f_{c}")
    dens = sum((F.col(f"_n_{c}") for c in cat_cols), F.lit(0.0))
    rows = rows.withColumn("_dens", dens).drop(*[f"_n_{c}" for c in cat_cols])
    chosen = []
    for _ in range(k):
        away = [sum(((~F.col(c).eqNullSafe(F.lit(p[c]))).cast("double") for c in cat_cols), F.lit(0.0))
                for p in chosen]
        gain = F.col("_dens") * (F.least(*away) if len(away) > 1 else away[0]) if away else F.col("_dens")
        chosen.append(rows.agg(F.max_by(F.struct(*base.columns), F.struct(gain, -F.col(id_col))).alias("r"))
                      .first()["r"].asDict())
    return chosen


def _mixed_round(base: DataFrame, names: DataFrame, num_cols: list[str], cat_cols: list[str], protos: dict, runs: list,
                 gamma: float):
    """One pass over ``base`` (rows with a weight ``_w``) for every running start: sizes, costs and means of the clusters
    (collected: runs × clusters rows) and the modes of their categories (counted
    in Spark by the categories' hashes, named by ``names``, the modes collected)."""
    p, c = len(num_cols), len(cat_cols)
    held = [(runs.index(r), np.array([[q[x] for x in num_cols] for q in ps], float).reshape(len(ps), p),
             np.array([[q[f"_h_{x}"] for x in cat_cols] for q in ps], np.int64).reshape(len(ps), c),
             [q["cluster"] for q in ps]) for r, ps in protos.items()]
    b = base.sparkSession.sparkContext.broadcast(held)
    hashes = [f"_h_{x}" for x in cat_cols]

    def fn(it):
        sums, seen = {}, {}
        for pdf in it:
            x = pdf[num_cols].to_numpy(dtype=float).reshape(len(pdf), p)
            n = pdf["_w"].to_numpy(dtype=float)
            # a batch's categories are numbered once, for all starts
            coded = [np.unique(pdf[h].to_numpy(dtype=np.int64), return_inverse=True) for h in hashes]
            for run, pn, pc, ids in b.value:
                d, unlike = np.zeros((len(x), len(ids))), np.zeros((len(x), len(ids)))
                for j in range(p):
                    d += (x[:, j, None] - pn[:, j]) ** 2
                for j, (names_, at) in enumerate(coded):
                    unlike += (names_[:, None] != pc[:, j])[at]
                d += gamma * unlike
                near = d.argmin(1)
                best = d[np.arange(len(x)), near]
                part = np.column_stack([np.bincount(near, weights=w * n, minlength=len(ids))
                                        for w in (np.ones(len(x)), best, *x.T)])
                sums[run] = sums[run] + part if run in sums else part
                for j, (names_, at) in enumerate(coded):
                    size = len(names_)
                    met = np.bincount(near * size + at, weights=n, minlength=len(ids) * size)
                    for t in np.flatnonzero(met).tolist():
                        key = (run, ids[t // size], j, int(names_[t % size]))
                        seen[key] = seen.get(key, 0) + int(met[t])
        rows = [(run, ids[k], None, None, row.tolist()) for run, _, _, ids in b.value if run in sums
                for k, row in enumerate(sums[run]) if row[0]]
        rows += [(*key, [float(n)]) for key, n in seen.items()]
        if rows:
            run, cluster, var, code, v = zip(*rows)
            # nullable integers: a hash does not survive a detour through floats
            yield pd.DataFrame({"run": run, "cluster": cluster, "var": pd.array(var, "Int32"),
                                "code": pd.array(code, "Int64"), "v": v})

    part = base.select(*num_cols, *hashes, "_w").mapInPandas(
        fn, "run int, cluster int, var int, code long, v array<double>")
    sums = saved(part.groupBy("run", "cluster", "var", "code").agg(
        *[F.sum(F.get("v", F.lit(j))).alias(f"s{j}") for j in range(p + 2)]), "round")
    num = [{"run": r["run"], "cluster": r["cluster"], "cost": r["s1"],
            "mean": [r[f"s{j + 2}"] / r["s0"] for j in range(p)]} for r in sums.where("var is null").collect()]
    b.destroy()
    named = sums.where("var is not null").join(small(names), ["var", "code"])
    modes = {(r["run"], r["cluster"], cat_cols[r["var"]]): r["m"] for r in named.groupBy("run", "cluster", "var").agg(
        F.min_by(F.struct("val", "code"), F.struct(-F.col("s0"), F.col("val"))).alias("m")).collect()}
    return num, modes


def kprototypes_sweep(df: DataFrame, num_cols: list[str], cat_cols: list[str], k_range=range(2, 8),
                      id_col: str = "row_id", gamma: float | None = None, n_init: int = 3,
                      max_iter: int = 100, seed: int = SEED, starts: dict | None = None):
    """Mixed-type k-prototypes for every k: ``(labels (k, id, cluster), [(k, cost, converged)])``.

    cost(x, c) = Σ (x_num − c_num)² + γ·#(x_cat ≠ c_cat); γ defaults to half
    the mean numeric standard deviation.  The first start of each k takes dense,
    distant rows (:func:`_dense_rows`), the others seeded samples.  All starts of
    all k iterate together: each step is one Arrow-batched scan that assigns
    every row under every running start and returns per-cluster sums and category
    counts.  A start has converged when its cost
    no longer falls; the returned cost belongs to the returned labels.  ``starts``
    (``(k, i) -> rows as dicts``) replaces the drawn ones.
    Numeric columns must be complete (median-impute first), categorical
    columns complete (fill with 'Otro' or the mode).
    """
    base = saved(df.select(id_col, *[_q(c).cast("double").alias(c) for c in num_cols],
                           *[_q(c).cast("string").alias(c) for c in cat_cols],
                           *[F.xxhash64(_q(c).cast("string")).alias(f"_h_{c}") for c in cat_cols]), "mixed")
    items = F.array(*[F.struct(F.lit(i).alias("var"), F.col(f"_h_{c}").alias("code"), F.col(c).alias("val"))
                      for i, c in enumerate(cat_cols)]) if cat_cols else None
    names = (saved(base.select(F.explode(items).alias("x")).select("x.*").distinct(), "categories") if cat_cols else
             base.sparkSession.createDataFrame([], "var int, code long, val string"))
    if gamma is None:
        st = base.agg(*[F.stddev_samp(c).alias(c) for c in num_cols]).first()
        gamma = 0.5 * float(np.mean([st[c] or 0.0 for c in num_cols])) if num_cols else 1.0

    def assign(protos):
        opts = []
        for p in protos:
            cost = sum(((_q(c) - F.lit(float(p[c]))) ** 2 for c in num_cols), F.lit(0.0))
            cost = cost + F.lit(gamma) * sum(((_q(c) != F.lit(p[c])).cast("double") for c in cat_cols),
                                             F.lit(0.0))
            opts.append(F.struct(cost.alias("d"), F.lit(p["cluster"]).alias("id")))
        return F.least(*opts) if len(opts) > 1 else opts[0]

    # equal answers move together: one row with their number stands for them
    alike = saved(base.groupBy(*num_cols, *[f"_h_{c}" for c in cat_cols]).agg(F.count(F.lit(1)).alias("_w")), "alike")
    protos = {}
    dense = _dense_rows(base, cat_cols, id_col, max(k_range)) if cat_cols and not starts else []
    for k in k_range:
        for init in range(sum(r[0] == k for r in starts) if starts else n_init):
            if starts:
                ps = [dict(r, **{f"_h_{c}": h for c, h in zip(cat_cols, _hashes(base, [r[c] for c in cat_cols]))})
                      for r in starts[k, init]]
            elif init == 0 and dense:
                ps = [dict(r) for r in dense[:k]]
            else:
                ps = [r.asDict() for r in md5_sample(base, id_col, k, seed + init).collect()]
            for i, p in enumerate(ps):
                p["cluster"] = i
            protos[k, init] = ps
    runs = sorted(protos)
    cost, active, converged = {}, list(runs), set()
    last = dict(protos)
    for _ in range(max_iter + 1):
        if not active:
            break
        num, modes = _mixed_round(alike, names, num_cols, cat_cols, {r: protos[r] for r in active}, runs, gamma)
        still = []
        for run in active:
            i = runs.index(run)
            rows = [r for r in num if r["run"] == i]
            tot = float(sum(r["cost"] for r in rows))
            # ``last`` keeps the prototypes that ``tot`` was measured with
            last[run] = protos[run]
            done = run in cost and cost[run] - tot <= 1e-9 * max(1.0, abs(tot))
            cost[run] = tot
            if done:
                converged.add(run)
                continue
            new = []
            for r in sorted(rows, key=lambda r: r["cluster"]):
                p = {"cluster": r["cluster"], **dict(zip(num_cols, r["mean"]))}
                for c in cat_cols:
                    p[c], p[f"_h_{c}"] = modes[i, r["cluster"], c]
                new.append(p)
            protos[run] = new
            still.append(run)
        active = still
    labels, costs = None, []
    for k in k_range:
        best = min((r for r in runs if r[0] == k), key=lambda r: (cost[r], r))
        lab = base.select(F.lit(k).alias("k"), id_col, assign(last[best])["id"].cast("long").alias("cluster"))
        labels = lab if labels is None else labels.unionByName(lab)
        costs.append((k, float(cost[best]), best in converged))
    return labels, costs


def kprototypes(df: DataFrame, num_cols: list[str], cat_cols: list[str], k: int, id_col: str = "row_id", **options):
    """k-prototypes for one k (M18): ``(labels (id, cluster), cost)``."""
    labels, costs = kprototypes_sweep(df, num_cols, cat_cols, [k], id_col, **options)
    return labels.drop("k"), costs[0][1]
