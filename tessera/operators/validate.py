"""Partition quality metrics and k selection.

The silhouette of record covers all rows in linear time (squared Euclidean
distances follow from per-cluster moments); the Euclidean silhouette covers
all rows by bounded tiles; the Dunn index is defined on a sample and returns its size.
Rows labelled ``-1`` (noise) take no part in the sweep's metrics.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.plans import survey_config as cfg
from tessera.sources.scratch import saved, small

SEED = 42
#: Rows of the Dunn index's sample.
DUNN_SAMPLE = 1000


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# ---------------------------------------------------------------------------
# sampling (O4)
# ---------------------------------------------------------------------------

def sample_key(id_col: str, seed: int = SEED) -> Column:
    """Deterministic pseudo-random order: md5 of seed and id (same in SQL)."""
    return F.md5(F.concat(F.lit(str(seed)), _q(id_col).cast("string")))


def md5_sample(df: DataFrame, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """Seeded sample without replacement of at most ``n`` rows.

    ``orderBy(key).limit(n)`` runs as a per-partition top-n then a merge
    (TakeOrderedAndProject): no full sort.
    """
    return df.withColumn("_sk", sample_key(id_col, seed)).orderBy("_sk", id_col).limit(n).drop("_sk")


# ---------------------------------------------------------------------------
# balance (A16, M20d)
# ---------------------------------------------------------------------------

def balance(labels: DataFrame, cluster_col: str = "cluster", group_cols: list[str] | tuple = (),
            weight: str | None = None) -> DataFrame:
    """cv = std(ddof 1)/mean of cluster sizes, min % and max % of a partition.

    ``(group..., n_clusters, cv, min_pct, max_pct)`` rounded 4 / 2 / 2 as reported.
    A row counts ``weight`` times.
    """
    sizes = labels.groupBy(*group_cols, cluster_col).agg((F.sum(_q(weight)) if weight else F.count(F.lit(1))).alias("sz"))
    return sizes.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.round(F.stddev_samp("sz") / F.avg("sz"), 4).alias("cv"),
        F.round(F.min("sz") / F.sum("sz") * 100.0, 2).alias("min_pct"),
        F.round(F.max("sz") / F.sum("sz") * 100.0, 2).alias("max_pct"))


# ---------------------------------------------------------------------------
# centroid based metrics
# ---------------------------------------------------------------------------

def centroids(df: DataFrame, cols: list[str], cluster_col: str = "cluster") -> DataFrame:
    """Mean of every dimension per cluster (A15) — k rows."""
    return df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"),
                                       *[F.avg(_q(c)).alias(c) for c in cols])


def _dist(cols: list[str], center: dict) -> Column:
    return F.sqrt(sum(((_q(c) - F.lit(float(center[c]))) ** 2 for c in cols), F.lit(0.0)))


def davies_bouldin(df: DataFrame, cols: list[str], cluster_col: str = "cluster") -> float:
    """Davies–Bouldin index.

    Centroids (k rows) are collected; the mean distance of the points to
    their own centroid is one more aggregation with the centroids inlined as
    literals (no join).  The k×k ratio matrix is computed on the driver.
    """
    cen = centroids(df, cols, cluster_col).collect()
    if len(cen) < 2:
        return float("nan")
    lab = [r[cluster_col] for r in cen]
    dist = F.lit(None).cast("double")
    for r in cen:
        dist = F.when(_q(cluster_col) == F.lit(r[cluster_col]), _dist(cols, r.asDict())).otherwise(dist)
    s = {r[cluster_col]: r["s"] for r in df.groupBy(cluster_col).agg(F.avg(dist).alias("s")).collect()}
    c = np.array([[r[x] for x in cols] for r in cen], dtype=float)
    sv = np.array([s[x] for x in lab], dtype=float)
    d = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(-1))
    if np.allclose(sv, 0) or np.allclose(d, 0):
        return 0.0
    d[d == 0] = np.inf                      # own centroid (and coincident ones) contribute 0
    ratio = (sv[:, None] + sv[None, :]) / d
    return float(np.mean(ratio.max(1)))


def nearest_label(cols: list[str], centers: list[dict], key: str = "cluster") -> Column:
    """The ``key`` of the nearest centre (ties → smaller): the centres are literals,
    ``least(struct(d², id))`` picks the closest."""
    opts = [F.struct(sum(((_q(c) - F.lit(float(ct[c]))) ** 2 for c in cols), F.lit(0.0)).alias("d"),
                     F.lit(ct[key]).alias("id")) for ct in centers]
    return (F.least(*opts) if len(opts) > 1 else opts[0])["id"]


def nearest_centroid(df: DataFrame, cols: list[str], centers: list[dict], key: str = "cluster",
                     out: str = "cluster") -> DataFrame:
    """Assign every row to the nearest centre (J8): a projection, no join, no shuffle."""
    return df.withColumn(out, nearest_label(cols, centers, key))


# ---------------------------------------------------------------------------
# distance-sum kernels
# ---------------------------------------------------------------------------

def _anchor_sums(points: DataFrame, cols: list[str], cluster_col: str, anchors: np.ndarray,
                 max_cells: int = 4_000_000) -> DataFrame:
    """Σ distance and count from every anchor to the points of each cluster.

    ``mapInPandas``: each task reduces its points against the broadcast
    anchor matrix (m × d, m bounded by the caller) to ``m × k`` partial sums;
    no pair is ever written out.  Returns ``(anchor, cluster, dsum, cnt)``.
    """
    sc = points.sparkSession.sparkContext
    b_anchors = sc.broadcast(anchors)
    cols = list(cols)
    # points per block so that a block × anchors × dims stays ~32 MB of doubles
    chunk = max(1, max_cells // max(1, anchors.shape[0] * anchors.shape[1]))

    def fn(it):
        a = b_anchors.value
        for pdf in it:
            if pdf.empty:
                continue
            x = pdf[cols].to_numpy(dtype=float)
            lab = pdf[cluster_col].to_numpy()
            out = []
            for lv in np.unique(lab):
                xs = x[lab == lv]
                tot = np.zeros(a.shape[0])
                for i in range(0, xs.shape[0], chunk):
                    blk = xs[i:i + chunk]
                    tot += np.sqrt(((a[:, None, :] - blk[None, :, :]) ** 2).sum(-1)).sum(1)
                out.append(pd.DataFrame({"anchor": np.arange(a.shape[0], dtype=np.int64),
                                         "cluster": np.int64(lv), "dsum": tot,
                                         "cnt": np.int64(xs.shape[0])}))
            if out:
                yield pd.concat(out, ignore_index=True)

    sel = points.select(*[_q(c).cast("double").alias(c) for c in cols],
                        _q(cluster_col).cast("long").alias(cluster_col))
    part = sel.mapInPandas(fn, "anchor long, cluster long, dsum double, cnt long")
    return part.groupBy("anchor", "cluster").agg(F.sum("dsum").alias("dsum"), F.sum("cnt").alias("cnt"))


def silhouette_sample(df: DataFrame, cols: list[str], cluster_col: str = "cluster", id_col: str = "row_id",
                      n_anchors: int = 5000, seed: int = SEED) -> tuple[float, int]:
    """Mean Euclidean silhouette over a seeded sample of anchors.

    Returns ``(silhouette, anchors used)``.  Every anchor's value is exact,
    measured against all rows.  Own-cluster mean excludes the anchor itself; an
    anchor alone in its cluster scores 0.  :func:`silhouette` scores all rows.
    """
    base = df.select(id_col, cluster_col, *cols)
    arows = md5_sample(base, id_col, n_anchors, seed).collect()
    if not arows:
        return float("nan"), 0
    a = np.array([[r[c] for c in cols] for r in arows], dtype=float)
    alab = np.array([r[cluster_col] for r in arows])
    sums = _anchor_sums(base, cols, cluster_col, a)
    sizes = {r["cluster"]: r["n"] for r in base.groupBy(F.col(cluster_col).cast("long").alias("cluster"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return float("nan"), len(arows)
    own = df.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(alab)], "anchor long, own long")
    d = sums.join(own, "anchor").groupBy("anchor").agg(
        F.max(F.when(F.col("cluster") == F.col("own"), F.when(F.col("cnt") > 1, F.col("dsum") / (F.col("cnt") - 1))))
        .alias("a"),
        F.min(F.when(F.col("cluster") != F.col("own"), F.col("dsum") / F.col("cnt"))).alias("b"))
    far = F.greatest("a", "b")
    s = F.when(F.col("a").isNull() | (far == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / far)
    return float(d.agg(F.avg(s)).first()[0]), len(arows)


def distance_sums(x: np.ndarray, y: np.ndarray, cells: int = 1 << 17) -> np.ndarray:
    """Sum of the distances of every row of ``x`` to the rows of ``y``, a dimension
    after the other, a few rows (``cells`` distances) at a time."""
    out, step = np.empty(len(x)), max(1, cells // max(1, len(y)))
    columns = np.ascontiguousarray(y.T)
    for lo in range(0, len(x), step):
        a = x[lo:lo + step]
        d2 = np.zeros((len(a), len(y)))
        for j, c in enumerate(columns):
            gap = a[:, j, None] - c
            gap *= gap
            d2 += gap
        out[lo:lo + step] = np.sqrt(d2, out=d2).sum(1)
    return out


#: Bytes of a tile's coordinates, and tiles that one task compares with another.
TILE_BYTES = 1 << 17
TILES = 32


def silhouette(df: DataFrame, cols: list[str], cluster_col: str = "cluster", tile_bytes: int = TILE_BYTES
               ) -> tuple[float, int]:
    """Mean Euclidean silhouette over all rows (M20a): ``(silhouette, rows)``.

    The mean distance of a row to a cluster lies between its distance d to the
    centroid (triangle inequality) and sqrt(d^2 + variance) (Jensen), so most
    clusters cannot be the nearest other one; they are left out by whole tiles.
    Rows are dealt into tiles of one cluster and one nearest other cluster;
    tiles of rows meet tiles of their own cluster and of the clusters left, a few
    at a time, in one group each.  A group returns the rows' distance sums, so no
    pair is written and no task holds more than ``TILES`` + 1 tiles.  The work
    within clusters stays quadratic: the definition asks for all distances.

    A row alone in its cluster scores 0; fewer than two clusters give nan.  Rows
    with a null coordinate or label take no part.
    """
    cols = list(cols)
    rows = df.select(_q(cluster_col).cast("long").alias("own"), F.array(*[_q(c).cast("double") for c in cols]).alias("x"))
    rows = saved(rows.where(F.col("own").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
                 .withColumn("rid", F.monotonically_increasing_id()), "rows")
    mom = rows.groupBy("own").agg(F.count(F.lit(1)).alias("n"),
                                  *[F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(len(cols))],
                                  sum((F.var_pop(F.col("x")[j]) for j in range(len(cols))), F.lit(0.0)).alias("v"))
    clusters = mom.orderBy("own").collect()           # a row per cluster
    n_rows = sum(r["n"] for r in clusters)
    if len(clusters) < 2:
        return float("nan"), n_rows
    names = np.array([r["own"] for r in clusters], np.int64)
    centre = np.array([[r[f"m{j}"] for j in range(len(cols))] for r in clusters])
    variance = np.array([r["v"] for r in clusters])
    tile = max(16, tile_bytes // (8 * len(cols)))

    @F.pandas_udf("array<long>")
    def others(own: pd.Series, x: pd.Series) -> pd.Series:
        """The other clusters that can be the nearest, the likeliest first."""
        at = np.searchsorted(names, own.to_numpy())
        p = np.array(x.tolist(), float).reshape(len(x), len(cols))
        out = []
        for lo in range(0, len(p), 1024):
            d2 = ((p[lo:lo + 1024, None, :] - centre[None]) ** 2).sum(-1)
            mine = at[lo:lo + 1024]
            d2[np.arange(len(mine)), mine] = np.inf
            most = np.sqrt(d2 + variance)
            can = np.sqrt(d2) <= most.min(1, keepdims=True) * (1 + 1e-12)
            order = np.argsort(most, axis=1, kind="stable")
            out += [names[o[c[o]]].tolist() for o, c in zip(order, can)]
        return pd.Series(out)

    def dealt(t: DataFrame, keys: list[str]) -> DataFrame:
        """Rows grouped into tiles; equal rows are dealt by their number."""
        counts = t.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / tile).alias("_n"))
        return t.join(small(saved(counts, "counts")), keys).withColumn("part", F.pmod(F.xxhash64("rid"), "_n"))

    near = saved(rows.withColumn("others", others("own", "x")).withColumn("first", F.col("others")[0]), "near")
    ours = (dealt(near, ["own", "first"]).groupBy("own", "first", "part")
            .agg(F.collect_list("x").alias("xs"), F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
            .select(F.monotonically_increasing_id().alias("t"), "own", "xs",
                    F.concat(F.array("own"), "others").alias("meets")))
    ours = saved(ours, "tiles")
    theirs = saved(dealt(rows, ["own"]).groupBy(F.col("own").alias("c"), "part").agg(F.collect_list("x").alias("xs")),
                   "tiles")
    groups = -(-ours.count() // TILES)
    parts = theirs.groupBy("c").agg(F.max("part").alias("last"))
    left = (ours.select("t", "xs", F.explode("meets").alias("c")).join(small(saved(parts, "parts")), "c")
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
            .withColumn("g", F.pmod(F.xxhash64("t"), F.lit(groups))).select("c", "part", "g", "t", "xs"))
    right = (theirs.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
             .select("c", "part", "g", F.lit(-1).cast("long").alias("t"), "xs"))

    def meet(table):
        import pyarrow as pa

        def matrix(i):
            return table.column("xs")[i].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cols))

        ts = table.column("t").to_pylist()
        out = []
        for y in (matrix(i) for i, t in enumerate(ts) if t < 0):
            for i, t in enumerate(ts):
                if t < 0:
                    continue
                x = matrix(i)
                s = distance_sums(x, y)
                out.append((np.full(len(x), t), np.arange(len(x)), s))
        t, i, s = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"t": t, "i": i, "c": pa.array(np.full(len(t), table.column("c")[0].as_py())), "s": s})

    sums = (left.unionByName(right).groupBy("c", "part", "g").applyInArrow(meet, "t long, i long, c long, s double")
            .groupBy("t", "i", "c").agg(F.sum("s").alias("s")))
    sizes = mom.select(F.col("own").alias("c"), "n")
    d = sums.join(small(saved(sizes, "sizes")), "c").join(ours.select("t", "own"), "t").groupBy("t", "i").agg(
        F.max(F.when((F.col("c") == F.col("own")) & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(F.col("c") != F.col("own"), F.col("s") / F.col("n"))).alias("b"))
    far = F.greatest("a", "b")
    score = F.when(F.col("a").isNull() | (far == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / far)
    return float(d.agg(F.avg(score)).first()[0]), n_rows


def _mean(x: Column, w: Column | None) -> Column:
    """Mean of the known values, a row counting ``w`` times."""
    return F.avg(x) if w is None else F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))


def silhouette_all(points: DataFrame, cols: list[str], keys: list[str] | tuple = (),
                   cluster_col: str = "cluster", weight: str | None = None) -> DataFrame:
    """Silhouette of all rows on squared Euclidean distances.

    ``(keys..., sil)``.  The mean squared distance of a point to a cluster
    follows from the cluster's size, sum vector and sum of squares, so the cost
    is rows × clusters and nothing pairwise.  A point alone in its cluster
    scores 0; fewer than two clusters give null.  A row counts ``weight`` times.
    """
    keys = list(keys)
    sq = sum((_q(c).cast("double") * _q(c).cast("double") for c in cols), F.lit(0.0))
    w = (F.lit(1.0) if weight is None else _q(weight).cast("double"))
    p = points.select(*keys, F.col(cluster_col).cast("long").alias("_own"),
                      *[_q(c).cast("double").alias(c) for c in cols], sq.alias("_sq"), w.alias("_w"))
    w = F.col("_w")
    mom = p.groupBy(*keys, "_own").agg(F.sum(w).alias("n"), F.sum(F.col("_sq") * w).alias("q"),
                                       F.array(*[F.sum(_q(c) * w) for c in cols]).alias("s"))
    table = saved(mom.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.collect_list(F.struct(F.col("_own").alias("c"), "n", "q", "s")).alias("_cl")), "moments")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    if keys:
        joined = p.join(small(table), same)
    else:
        one = table.first()
        if one is None:
            return points.select(F.lit(None).cast("double").alias("sil")).limit(0)
        cl = F.array(*[F.struct(F.lit(r["c"]).alias("c"), F.lit(r["n"]).alias("n"), F.lit(r["q"]).alias("q"),
                                F.array(*[F.lit(x) for x in r["s"]]).alias("s")) for r in one["_cl"]])
        joined = p.withColumn("_cl", cl)

    def total(c):
        """Sum of squared distances of the row to the points of a cluster."""
        dot = sum((_q(x) * c["s"][i] for i, x in enumerate(cols)), F.lit(0.0))
        return F.greatest(c["n"] * F.col("_sq") - 2.0 * dot + c["q"], F.lit(0.0))

    own = F.filter("_cl", lambda c: c["c"] == F.col("_own"))
    a = F.transform(own, lambda c: F.when(c["n"] > 1, total(c) / (c["n"] - 1)))[0]
    b = F.array_min(F.transform(F.filter("_cl", lambda c: c["c"] != F.col("_own")), lambda c: total(c) / c["n"]))
    d = joined.select(*keys, a.alias("a"), b.alias("b"), "_w")
    far = F.greatest("a", "b")
    s = (F.when(F.col("b").isNull(), F.lit(None).cast("double"))
         .when(F.col("a").isNull() | (far == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / far))
    return d.groupBy(*keys).agg(_mean(s, F.col("_w") if weight else None).alias("sil"))


def dunn(df: DataFrame, cols: list[str], cluster_col: str = "cluster", id_col: str = "row_id",
         n_sample: int = 1000, seed: int = SEED) -> tuple[float, int]:
    """Dunn index on a seeded md5 sample (M20c, J6, O4): ``(dunn, sample size)``.

    min inter-cluster distance / max intra-cluster diameter over the sample;
    0 when no cluster has two sample points.  The sample (≤ ``n_sample`` rows:
    sampling is the operator's definition) is broadcast; tasks reduce their slice
    of it to per-cluster-pair minima / per-cluster maxima.
    """
    smp = md5_sample(df.select(id_col, cluster_col, *cols), id_col, n_sample, seed)
    rows = smp.collect()
    if not rows:
        return 0.0, 0
    a = np.array([[r[c] for c in cols] for r in rows], dtype=float)
    alab = np.array([r[cluster_col] for r in rows], dtype=np.int64)
    sc = df.sparkSession.sparkContext
    b = sc.broadcast((a, alab))
    cols = list(cols)

    def fn(it):
        aa, al = b.value
        for pdf in it:
            if pdf.empty:
                continue
            x = pdf[cols].to_numpy(dtype=float)
            lab = pdf[cluster_col].to_numpy(dtype=np.int64)
            d = np.sqrt(((x[:, None, :] - aa[None, :, :]) ** 2).sum(-1))
            out = []
            for lv in np.unique(lab):
                dl = d[lab == lv]
                for lw in np.unique(al):
                    blk = dl[:, al == lw]
                    if lv == lw:
                        out.append((int(lv), int(lw), float("nan"), float(blk.max())))
                    else:
                        out.append((int(lv), int(lw), float(blk.min()), float("nan")))
            yield pd.DataFrame(out, columns=["ca", "cb", "dmin", "dmax"])

    part = (smp.select(*[_q(c).cast("double").alias(c) for c in cols],
                       _q(cluster_col).cast("long").alias(cluster_col))
            .repartition(max(1, min(df.sparkSession.sparkContext.defaultParallelism, len(rows) // 64 + 1)))
            .mapInPandas(fn, "ca long, cb long, dmin double, dmax double"))
    res = part.agg(F.min(F.when(F.col("ca") != F.col("cb"), F.col("dmin"))).alias("inter"),
                   F.max(F.when(F.col("ca") == F.col("cb"), F.col("dmax"))).alias("intra")).first()
    sizes = {}
    for lv in alab:
        sizes[lv] = sizes.get(lv, 0) + 1
    if res["inter"] is None or res["intra"] is None or res["intra"] <= 0 or max(sizes.values()) < 2:
        return 0.0, len(rows)
    return float(res["inter"] / res["intra"]), len(rows)


# ---------------------------------------------------------------------------
# agreement between labelings
# ---------------------------------------------------------------------------

def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index between two labelings (M25): one-row ``(n, ari)``.

    Contingency counts (A17) by ``groupBy(a, b)``; the Σ C(n, 2) terms are
    aggregates of the contingency table and of its margins.
    """
    def c2(x):
        return x * (x - 1) / 2.0
    cont = df.where(_q(a).isNotNull() & _q(b).isNotNull()).groupBy(_q(a).alias("a"), _q(b).alias("b")).agg(
        F.count(F.lit(1)).cast("double").alias("nij"))
    ra = cont.groupBy("a").agg(F.sum("nij").alias("ai")).agg(F.sum(c2(F.col("ai"))).alias("v"))
    cb = cont.groupBy("b").agg(F.sum("nij").alias("bj")).agg(F.sum(c2(F.col("bj"))).alias("v"))
    tot = cont.agg(F.sum(c2(F.col("nij"))).alias("sij"), F.sum("nij").alias("n"))
    # the four one-row terms side by side without a join: union, then pivot
    terms = (ra.select(F.lit("sa").alias("t"), "v")
             .unionByName(cb.select(F.lit("sb").alias("t"), "v"))
             .unionByName(tot.select(F.lit("sij").alias("t"), F.col("sij").alias("v")))
             .unionByName(tot.select(F.lit("n").alias("t"), F.col("n").alias("v"))))
    one = terms.groupBy().pivot("t", ["sa", "sb", "sij", "n"]).agg(F.first("v"))
    pairs = c2(F.col("n"))
    exp = F.when(pairs > 0, F.col("sa") * F.col("sb") / F.nullif(pairs, F.lit(0.0))).otherwise(F.lit(0.0))
    mx = 0.5 * (F.col("sa") + F.col("sb"))
    ari = F.when(mx == exp, F.lit(1.0)).otherwise((F.col("sij") - exp) / (mx - exp))
    return one.select(F.col("n").cast("long").alias("n"), ari.alias("ari"))


# ---------------------------------------------------------------------------
# composite score, k selection, method comparison, relabel (M20e, M21, M22, W2, W4, D6)
# ---------------------------------------------------------------------------

def composite_score(sil="sil", db="db", dunn_="dunn", cv="cv", weights: tuple = cfg.SCORE_WEIGHTS) -> Column:
    """w1·sil + w2·dunn + w3/(1+db) + w4/(1+cv) (M20e); a missing cv counts as 0."""
    w1, w2, w3, w4 = weights
    return (F.lit(w1) * _q(sil) + F.lit(w2) * _q(dunn_) + F.lit(w3) / (1 + _q(db))
            + F.lit(w4) / (1 + F.coalesce(_q(cv), F.lit(0.0))))


def select_k(metrics: DataFrame, k_min: int = 3, share: float = cfg.MIN_SHARE,
             relaxed: float = cfg.MIN_SHARE_RELAXED, method_col: str = "method") -> DataFrame:
    """Chosen and second-best k per method.

    Chosen: best score in the first non-empty tier of (k ≥ k_min and
    min% ≥ share) → (min% ≥ relaxed) → (k ≥ k_min) → all.  Second: best
    score among the other k.  Ties → smaller k.  Runs on the metrics table
    (one row per method and k).
    """
    tier = (F.when((F.col("k") >= k_min) & (F.col("min_pct") >= share), 0)
            .when((F.col("k") >= k_min) & (F.col("min_pct") >= relaxed), 1)
            .when(F.col("k") >= k_min, 2).otherwise(3))
    w1 = W.partitionBy(method_col).orderBy("tier", F.desc("score"), "k")
    m = metrics.withColumn("tier", tier).withColumn("_r1", F.row_number().over(w1))
    chosen = m.where(F.col("_r1") == 1).select(method_col, F.col("k").alias("k_opt"))
    rest = m.join(chosen, method_col).where(F.col("k") != F.col("k_opt"))
    w2 = W.partitionBy(method_col).orderBy(F.desc("score"), "k")
    second = (rest.withColumn("_r2", F.row_number().over(w2)).where(F.col("_r2") == 1)
              .select(method_col, F.col("k").alias("k_second")))
    return (chosen.join(second, method_col, "left")
            .withColumn("k_second", F.coalesce("k_second", "k_opt")))


def compare_methods(metrics: DataFrame, choice: DataFrame, method_col: str = "method") -> DataFrame:
    """Metrics of every method and k with a 'best' / '2nd' mark."""
    j = metrics.join(choice, method_col)
    mark = (F.when(F.col("k") == F.col("k_opt"), F.lit("best"))
            .when(F.col("k") == F.col("k_second"), F.lit("2nd")).otherwise(F.lit("")))
    return j.withColumn("mark", mark).drop("k_opt", "k_second")


def relabel_by_score(df: DataFrame, cluster_col: str, score_col: str, out: str | None = None) -> DataFrame:
    """Dense relabel of clusters 0..k−1 by ascending mean of a score.

    The cluster means are ranked by the distributed rank (a density method can
    find very many clusters); ties go to the smaller cluster.
    """
    from tessera.operators.ranks import rank_histogram

    out = out or cluster_col
    means = saved(df.groupBy(F.col(cluster_col).alias("_c")).agg(F.avg(_q(score_col)).alias("_m")), "means")
    hist = means.groupBy(F.lit(0).alias("_k"), F.col("_m").alias("_v")).agg(F.count(F.lit(1)).alias("cnt"))
    rank = rank_histogram(hist, ["_k"], "_v").select("_v", "before")
    tie = F.row_number().over(W.partitionBy("_m").orderBy("_c")) - 1
    mp = (means.withColumn("_t", tie).join(rank, F.col("_m").eqNullSafe(F.col("_v")))
          .select("_c", (F.col("before") + F.col("_t")).alias("_new")))
    return (df.join(mp, F.col(cluster_col) == F.col("_c")).drop("_c")
            .withColumn(out, F.col("_new")).drop("_new"))


# ---------------------------------------------------------------------------
# all labelings at once (the k / method sweep of R21)
# ---------------------------------------------------------------------------

def _db_index(cols: list[str], keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Davies–Bouldin of one labeling from its centroid table."""
        c, s = pdf[cols].to_numpy(dtype=float), pdf["_s"].to_numpy(dtype=float)
        worst = np.zeros(len(c))
        for i in range(len(c)):
            d = np.sqrt(((c - c[i]) ** 2).sum(1))
            d[d == 0] = np.inf
            worst[i] = ((s + s[i]) / d).max()
        out = pdf[keys].iloc[:1].copy()
        out["db"] = worst.mean() if len(c) > 1 else np.nan
        return out
    return run


def _dunn_index(cols: list[str], keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Dunn index of one labeling on the shared sample."""
        x, lab = pdf[cols].to_numpy(dtype=float), pdf["cluster"].to_numpy()
        d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
        same = lab[:, None] == lab[None, :]
        intra = d[same].max() if len(x) else 0.0
        out = pdf[keys].iloc[:1].copy()
        out["dunn"] = float(d[~same].min() / intra) if intra > 0 and (~same).any() else 0.0
        out["n_dunn"] = len(x)
        return out
    return run


def metrics_table(points: DataFrame, cols: list[str], labels: DataFrame, id_col: str = "row_id",
                  label_keys: tuple = ("method", "k"), dunn_sample: int = DUNN_SAMPLE,
                  seed: int = SEED) -> DataFrame:
    """sil, db, dunn, n_dunn, cv, min_pct, max_pct and score for every labeling in one sweep.

    ``labels`` is long: ``(label_keys..., id, cluster)``; noise (cluster < 0)
    is left out first.  ``sil`` is :func:`silhouette_all`.  Dunn uses one seeded
    sample of ``dunn_sample`` points for all labelings, of which ``n_dunn`` are
    not noise in this one.  Values are rounded to 4 / 2 decimals as reported.
    """
    keys = list(label_keys)
    cols = list(cols)
    pts = points.select(id_col, *[_q(c).cast("double").alias(c) for c in cols])
    lab = labels.select(*keys, id_col, F.col("cluster").cast("long").alias("cluster")).where("cluster >= 0")
    lp = saved(lab.join(pts, id_col), "labelled")
    sample = md5_sample(pts, id_col, dunn_sample, seed).select(id_col)
    return labelled_metrics(lp, cols, lp.join(F.broadcast(sample), id_col), keys)


def labelled_metrics(lp: DataFrame, cols: list[str], sampled: DataFrame, keys: list[str],
                     weight: str | None = None) -> DataFrame:
    """:func:`metrics_table` of ``lp`` (``keys, cluster, coordinates``, without noise), a
    row of which counts ``weight`` times; ``sampled`` has the sample's rows likewise."""
    w = _q(weight) if weight else None
    types = lp.select(*keys).schema.simpleString()[7:-1].replace(":", " ")
    cen = saved(lp.groupBy(*keys, "cluster").agg(*[_mean(_q(c), w).alias(c) for c in cols]), "centroids")
    dist = F.sqrt(sum(((_q(c) - F.col(f"_c_{c}")) ** 2 for c in cols), F.lit(0.0)))
    own = cen.select(*keys, "cluster", *[_q(c).alias(f"_c_{c}") for c in cols])
    spread = lp.join(small(own), [*keys, "cluster"]).groupBy(*keys, "cluster").agg(_mean(dist, w).alias("_s"))
    db = (cen.join(spread, [*keys, "cluster"]).groupBy(*keys)
          .applyInPandas(_db_index(cols, keys), f"{types}, db double"))
    dunn_ = (sampled.select(*keys, "cluster", *cols).groupBy(*keys)
             .applyInPandas(_dunn_index(cols, keys), f"{types}, dunn double, n_dunn long"))
    bal = balance(lp, "cluster", keys, weight).drop("n_clusters")
    m = (silhouette_all(lp, cols, keys, weight=weight).join(db, keys).join(dunn_, keys, "left").join(bal, keys)
         .withColumn("dunn", F.coalesce("dunn", F.lit(0.0)))
         .withColumn("n_dunn", F.coalesce("n_dunn", F.lit(0))))
    score = composite_score()
    return m.select(*keys, F.round("sil", 4).alias("sil"), F.round("db", 4).alias("db"),
                    F.round("dunn", 4).alias("dunn"), "n_dunn", "cv", "min_pct", "max_pct",
                    F.round(score, 4).alias("score"))
