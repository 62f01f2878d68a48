"""k-means for many starts at once (M16), exact, with rows that a round need not see.

The rows hang below the leaves of a clustering-feature tree (``ward.micro_clusters``):
the driver holds size, sums, squares and bounding box of a few thousand leaves.

*Starts* are k-means++ draws over all leaves by their weight and squared distance,
so every row counts; with no more distinct points than leaves they are k-means++
on the rows.

*Rounds.*  For one start, a leaf is settled if its second nearest centre is farther
from its middle than the nearest one by more than its diameter: all its points
then have the same nearest centre, and its feature is added to that centre
without its rows.  What the difference exceeds the diameter by is the leaf's
slack; until the centres have moved by half of it, nothing about the leaf needs
to be computed again.  Only the rows of unsettled leaves are read, for the starts
that need them, in one scan for all.  Starts whose centres have become those of
another start of the same k go on as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.validate import SEED, nearest_label
from tessera.operators.ward import micro_clusters
from tessera.sources.scratch import saved


#: Leaves of the tree that the driver holds (about 100 bytes for each, and 25 per start).
MICRO = 1 << 14


class Leaves:
    """Size, sums, sums of squares and bounding boxes of the leaves of ``rows``, which
    have a weight ``_w``."""

    def __init__(self, rows: DataFrame, cols: list[str]):
        every = [f(F.col(f"`{c}`")).alias(f"{n}{j}") for j, c in enumerate(cols)
                 for n, f in (("s", lambda x: F.sum(x * F.col("_w"))), ("lo", F.min), ("hi", F.max))]
        squares = [F.sum(F.col(f"`{c}`") * F.col(f"`{c}`") * F.col("_w")).alias(f"q{j}") for j, c in enumerate(cols)]
        got = rows.groupBy("_micro").agg(F.sum("_w").alias("n"), *every, *squares).toArrow().sort_by("_micro")

        def table(name):
            return np.column_stack([got[f"{name}{j}"].to_numpy().astype(float) for j in range(len(cols))])

        self.names = got["_micro"].to_numpy().astype(np.int64)
        self.n = got["n"].to_numpy().astype(float)
        self.s, self.q, self.lo, self.hi = table("s"), table("q"), table("lo"), table("hi")
        self.mean = self.s / self.n[:, None]
        self.features = [self.n, *np.ascontiguousarray(self.s.T)]
        self.bounds()

    def bounds(self) -> None:
        self.middle, self.diameter = (self.lo + self.hi) / 2, np.sqrt(((self.hi - self.lo) ** 2).sum(1))
        self.point = self.diameter == 0

    def variance(self) -> float:
        """Mean variance of the columns."""
        total = self.n.sum()
        return float(np.mean(np.maximum(self.q.sum(0) / total - (self.s.sum(0) / total) ** 2, 0.0)))

    def nearest(self, centers: np.ndarray, which=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(centre nearest to the middle of each leaf, its slack); a leaf with a positive
        slack, and one that is a single point, has that centre for all its points."""
        middle, diameter = self.middle[which], self.diameter[which]
        # squares expand into one product; ties and near ties are decided below
        d2 = np.maximum((middle ** 2).sum(1)[:, None] - 2.0 * (middle @ centers.T) + (centers ** 2).sum(1), 0.0)
        near = d2.argmin(1)
        if len(centers) == 1:
            return near, np.full(len(near), np.inf)
        row = np.arange(len(near))
        least = np.sqrt(d2[row, near])
        d2[row, near] = np.inf
        second = np.sqrt(d2.min(1))
        close = np.flatnonzero(second - least <= 1e-6 * (second + 1.0))
        if len(close):
            near[close] = ((middle[close, None, :] - centers[None]) ** 2).sum(-1).argmin(1)
        return near, second - least - diameter - 1e-9 * (second + 1.0)

    def add_up(self, slot: np.ndarray, k: int) -> np.ndarray:
        """Per centre: size, sums (and room for the cost) over the leaves whose ``slot``
        is the centre; those of slot ``k`` belong to none."""
        out = np.zeros((k, self.s.shape[1] + 2))
        for j, v in enumerate(self.features):
            out[:, j] = np.bincount(slot, weights=v, minlength=k + 1)[:k]
        return out

    def costs(self, slot: np.ndarray, centers: np.ndarray) -> np.ndarray:
        """Per centre: squared distances of the points of the leaves whose ``slot`` it is."""
        k = len(centers)
        c = centers[np.minimum(slot, k - 1)]
        cost = (self.q - 2 * c * self.s + c * c * self.n[:, None]).sum(1)
        return np.bincount(slot, weights=np.maximum(cost, 0.0), minlength=k + 1)[:k]


def plus_plus(mean: np.ndarray, weight: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++ over weighted points."""
    centers = [mean[rng.choice(len(mean), p=weight / weight.sum())]]
    d = ((mean - centers[0]) ** 2).sum(1)
    for _ in range(k - 1):
        mass = d * weight
        pick = rng.integers(len(mean)) if mass.sum() == 0 else rng.choice(len(mean), p=mass / mass.sum())
        centers.append(mean[pick])
        d = np.minimum(d, ((mean - centers[-1]) ** 2).sum(1))
    return np.array(centers)


#: Rows that a task compares with the centres at once.
SCAN_ROWS = 1 << 16
#: Tasks whose sums the driver adds up itself; those of more tasks are added by a shuffle.
FEW_TASKS = 64


def _blocks(it, rows: int):
    """The batches' columns as arrays, batches joined up to ``rows`` rows."""
    held, n = [], 0
    for batch in it:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _scan(rows: DataFrame, cols: list[str], leaves: Leaves, centers: dict, open_: dict, few: bool = False) -> dict:
    """Per start: size, sums and cost per centre over the rows of its open leaves.

    Which leaves are open goes to the tasks with the centres: as a condition of the
    plan they are thousands of literals, analysed anew in every round.  Tasks return
    a row per start and centre; of a ``few`` tasks the driver adds these up, as planning
    and running a shuffle takes longer than a round's work."""
    runs = sorted(centers)
    held = rows.sparkSession.sparkContext.broadcast(
        (leaves.names, [centers[r] for r in runs], np.packbits([open_[r] for r in runs], axis=1)))

    def fn(it):
        names, cs, bits = held.value
        mask = np.unpackbits(bits, axis=1, count=len(names)).astype(bool)
        wanted = mask.any(0)
        total = [np.zeros((len(c), c.shape[1] + 2)) for c in cs]
        for t in _blocks(it, SCAN_ROWS):
            leaf = np.searchsorted(names, t["_micro"].to_numpy())
            some = np.flatnonzero(wanted[leaf])
            leaf, w = leaf[some], t["_w"].to_numpy()[some].astype(float)
            x = [t[c].to_numpy()[some] for c in cols]
            for i, c in enumerate(cs):
                at = np.flatnonzero(mask[i][leaf])
                if not len(at):
                    continue
                d, mine, n = np.zeros((len(at), len(c))), [], w[at]
                for j, v in enumerate(x):
                    v = v[at]
                    mine.append(v * n)
                    d += (v[:, None] - c[:, j]) ** 2
                near = d.argmin(1)
                for j, v in enumerate([n, *mine, d[np.arange(len(at)), near] * n]):
                    total[i][:, j] += np.bincount(near, weights=v, minlength=len(c))
        out = [(i, j, row.tolist()) for i, t in enumerate(total) for j, row in enumerate(t) if row[0]]
        if out:
            run, cluster, v = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(cluster, pa.int32()),
                                              pa.array(v, pa.list_(pa.float64()))], ["run", "cluster", "v"])

    sums = rows.mapInArrow(fn, "run int, cluster int, v array<double>")
    if not few:
        sums = sums.groupBy("run", "cluster").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(len(cols) + 2)]).alias("v"))
    got = sums.collect()
    held.destroy()
    out = {r: np.zeros((len(centers[r]), len(cols) + 2)) for r in runs}
    for run, cluster, v in got:
        out[runs[run]][cluster] += v
    return out


class _Start:
    """Centres of a start, and what is known about the leaves under them."""

    def __init__(self, centers: np.ndarray, leaves: Leaves):
        self.centers, self.leaves = centers, leaves
        self.near = np.zeros(len(leaves.n), np.int32)
        self.until = np.full(len(leaves.n), -1.0)       # way that centres may go before a leaf is looked at
        self.settled = np.zeros(len(leaves.n), bool)
        self.slot = np.full(len(leaves.n), len(centers), np.int32)      # centre of a settled leaf, else their number
        self.way = 0.0

    def move(self, centers: np.ndarray) -> float:
        step = ((centers - self.centers) ** 2).sum(1)
        self.centers, self.way = centers, self.way + float(np.sqrt(step.max()))
        return float(step.sum())

    def look(self, cost: bool = True) -> np.ndarray:
        """Sums over settled leaves, with their ``cost`` if wanted; afterwards ``settled``
        tells which these are."""
        stale = np.flatnonzero(self.until <= self.way)
        k = len(self.centers)
        if len(stale):
            near, slack = self.leaves.nearest(self.centers, stale)
            point = self.leaves.point[stale]
            settled = (slack > 0) | point
            # the slack of an open leaf changes no faster: until then it stays open
            self.until[stale] = self.way + np.where(point, slack, np.abs(slack)) / 2
            self.near[stale], self.settled[stale] = near, settled
            self.slot[stale] = np.where(settled, near, k)
        out = self.leaves.add_up(self.slot, k)
        if cost:
            out[:, -1] = self.leaves.costs(self.slot, self.centers)
        return out


def lloyd_round(rows: DataFrame, cols: list[str], starts: dict, cost: bool = True, few: bool = False) -> dict:
    """start -> (sizes, sums, cost) of the assignment to its centres; without ``cost``
    that of the settled leaves is left out.  ``few``: see :func:`_scan`."""
    out = {run: s.look(cost) for run, s in starts.items()}
    open_ = {run: ~s.settled for run, s in starts.items() if not s.settled.all()}
    if open_:
        leaves = next(iter(starts.values())).leaves
        for run, part in _scan(rows, cols, leaves, {r: starts[r].centers for r in open_}, open_, few).items():
            out[run] += part
    return {r: (t[:, 0], t[:, 1:-1], float(t[:, -1].sum())) for r, t in out.items()}


def _same(centers: np.ndarray) -> bytes:
    """Centres in any order, to nine digits."""
    scale = np.abs(centers).max() or 1.0
    x = np.round(centers / scale, 9) + 0.0
    return x[np.lexsort(x.T[::-1])].tobytes() + np.round(scale, 9).tobytes()


def kmeans_fit(df: DataFrame, cols: list[str], ks, n_init: int = 30, max_iter: int = 500, seed: int = SEED,
               id_col: str = "row_id", n_micro: int = MICRO, tol: float = 1e-4, starts: dict | None = None,
               weight: str | None = None) -> dict:
    """k -> (centres, inertia, converged): the best of ``n_init`` starts for every k.

    ``starts`` (``(k, i) -> centres``) replaces the drawn ones.  A start ends when
    its centres move less than ``tol`` times the mean variance or after
    ``max_iter`` rounds, which the result tells.  The inertia belongs to the
    returned centres.  Rows with a null coordinate take no part; one row counts
    ``weight`` times.
    """
    cols = list(cols)
    base = saved(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols],
                           (F.lit(1) if weight is None else F.col(f"`{weight}`")).cast("long").alias("_n")), "points")
    rows, _, _ = micro_clusters(base, cols, n_micro, weight="_n")
    # equal rows move together: one with their number stands for them
    rows = saved(rows.groupBy("_micro", *cols).agg(F.sum("_n").alias("_w")).select("_micro", "_w", *cols), "leaves")
    few = rows.rdd.getNumPartitions() <= FEW_TASKS
    leaves = Leaves(rows, cols)
    rng = np.random.default_rng(seed)
    centers = starts or {(k, i): plus_plus(leaves.mean, leaves.n, k, rng) for k in ks for i in range(n_init)}
    runs = {run: _Start(c, leaves) for run, c in centers.items()}
    limit = tol * leaves.variance()
    active, converged, stands_for = set(runs), set(), {}
    for _ in range(max_iter):
        if not active:
            break
        known: dict = {}
        for run in sorted(runs):
            if run not in stands_for and (first := known.setdefault((run[0], _same(runs[run].centers)), run)) != run:
                stands_for[run] = first
                active.discard(run)
        for run, (n, s, _) in lloyd_round(rows, cols, {r: runs[r] for r in sorted(active)}, cost=False, few=few).items():
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1.0)[:, None], runs[run].centers)
            if runs[run].move(new) <= limit:
                active.discard(run)
                converged.add(run)
    own = {r: s for r, s in runs.items() if r not in stands_for}
    cost = {r: c for r, (_, _, c) in lloyd_round(rows, cols, own, few=few).items()}
    best = {k: min((c, r) for r, c in cost.items() if r[0] == k) for k in sorted({r[0] for r in own})}
    return {k: (runs[r].centers, c, r in converged) for k, (c, r) in best.items()}


def centre_label(cols: list[str], centres: np.ndarray) -> Column:
    """The number of the nearest of the ``centres``."""
    return nearest_label(cols, [dict(zip(cols, map(float, c)), cluster=i) for i, c in enumerate(centres)])


def kmeans_sweep(df: DataFrame, cols: list[str], k_range=range(2, 8), n_init: int = 30, max_iter: int = 500,
                 id_col: str = "row_id", seed: int = SEED, weight: str | None = None, **options):
    """k-means for every k: ``(labels long table (k, row_id, cluster), [(k, inertia,
    converged)], {k: centres})``; labels are projections without a join."""
    base = saved(df.select(id_col, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols], *([weight] if weight else [])),
                 "points")
    fitted = kmeans_fit(base, cols, list(k_range), n_init, max_iter, seed, id_col, weight=weight, **options)
    labels = None
    for k, (centres, _, _) in fitted.items():
        part = base.select(F.lit(k).alias("k"), id_col, centre_label(list(cols), centres).alias("cluster"))
        labels = part if labels is None else labels.unionByName(part)
    return (labels, [(k, float(c), done) for k, (_, c, done) in fitted.items()],
            {k: c for k, (c, _, _) in fitted.items()})
