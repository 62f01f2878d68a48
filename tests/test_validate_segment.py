"""Metrics and segmentation against brute-force numpy implementations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kmeans, segment, validate, ward


def _points(spark, x, lab=None):
    rows = [(i, *map(float, r), int(lab[i]) if lab is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["row_id", *[f"x{j}" for j in range(x.shape[1])], "cluster"])


def _blobs(n=240, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0, 0], [3, 3, 0], [0, 3, 3]], dtype=float)
    lab = rng.integers(0, 3, n)
    return centers[lab] + rng.normal(scale=0.4, size=(n, 3)), lab


def _silhouette_brute(x, lab, squared=False):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    d = d if squared else np.sqrt(d)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in np.unique(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_exact(spark):
    x, lab = _blobs()
    df = _points(spark, x, lab)
    assert validate.silhouette_sample(df, ["x0", "x1", "x2"], "cluster", n_anchors=50)[1] == 50
    for anchors in (240, 500):
        got, n = validate.silhouette_sample(df, ["x0", "x1", "x2"], "cluster", n_anchors=anchors)
        assert abs(got - _silhouette_brute(x, lab)) < 1e-9 and n == len(x)
    sq = _silhouette_brute(x, lab, squared=True)
    assert abs(validate.silhouette_all(df, ["x0", "x1", "x2"]).first().sil - sq) < 1e-9


@pytest.mark.parametrize("tile_bytes", [1 << 17, 24 * 20])
def test_silhouette_over_tiles(spark, tile_bytes):
    """One tile per cluster and many; a hot point, a single row, overlapping clusters."""
    rng = np.random.default_rng(2)
    x, lab = _blobs(300, seed=1)
    x = np.vstack([x, np.repeat([[1.0, 1.0, 1.0]], 90, axis=0), [[9, 9, 9]], rng.normal(size=(40, 3))])
    lab = np.concatenate([lab, rng.integers(0, 3, 90), [7], rng.integers(3, 6, 40)])
    got, n = validate.silhouette(_points(spark, x, lab).repartition(4), ["x0", "x1", "x2"], tile_bytes=tile_bytes)
    assert abs(got - _silhouette_brute(x, lab)) < 1e-9 and n == len(x)
    one = _points(spark, x[:3], np.zeros(3, int))
    assert np.isnan(validate.silhouette(one, ["x0", "x1", "x2"])[0])


def test_davies_bouldin_and_dunn(spark):
    x, lab = _blobs()
    df = _points(spark, x, lab)
    cen = np.array([x[lab == c].mean(0) for c in range(3)])
    s = np.array([np.sqrt(((x[lab == c] - cen[c]) ** 2).sum(1)).mean() for c in range(3)])
    d = np.sqrt(((cen[:, None] - cen[None]) ** 2).sum(-1))
    db = np.mean([max((s[i] + s[j]) / d[i, j] for j in range(3) if j != i) for i in range(3)])
    assert abs(validate.davies_bouldin(df, ["x0", "x1", "x2"], "cluster") - db) < 1e-9
    dd = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    same = lab[:, None] == lab[None]
    dunn = dd[~same].min() / dd[same].max()
    got, n = validate.dunn(df, ["x0", "x1", "x2"], "cluster", n_sample=1000)
    assert abs(got - dunn) < 1e-9 and n == len(x)
    assert validate.dunn(df, ["x0", "x1", "x2"], "cluster", n_sample=40)[1] == 40


def test_ari_identity_and_formula(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3, 200), rng.integers(0, 4, 200)
    df = spark.createDataFrame([(int(u), int(v)) for u, v in zip(a, b)], "a long, b long")
    assert abs(validate.adjusted_rand(df, "a", "a").first().ari - 1.0) < 1e-12
    from math import comb
    cont = np.zeros((3, 4))
    for u, v in zip(a, b):
        cont[u, v] += 1
    sij = sum(comb(int(v), 2) for v in cont.ravel())
    sa = sum(comb(int(v), 2) for v in cont.sum(1))
    sb = sum(comb(int(v), 2) for v in cont.sum(0))
    e = sa * sb / comb(200, 2)
    ari = (sij - e) / (0.5 * (sa + sb) - e)
    assert abs(validate.adjusted_rand(df, "a", "b").first().ari - ari) < 1e-12


def test_select_k_tiers(spark):
    rows = [("m", 2, 0.9, 40.0), ("m", 3, 0.5, 12.0), ("m", 4, 0.6, 8.0), ("m", 5, 0.4, 16.0),
            ("n", 2, 0.9, 40.0), ("n", 3, 0.3, 5.0)]
    met = spark.createDataFrame(rows, "method string, k int, score double, min_pct double")
    got = {r.method: (r.k_opt, r.k_second) for r in validate.select_k(met, k_min=3).collect()}
    assert got["m"] == (5, 2)          # k≥3 with min%≥15 only k=5; second best overall k=2
    assert got["n"] == (3, 2)          # nothing passes the share rules → best with k≥3


def test_balance(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(2,)] * 2, "cluster int")
    b = validate.balance(df, "cluster").first()
    sizes = np.array([6, 2, 2])
    assert b.n_clusters == 3 and b.min_pct == 20.0 and b.max_pct == 60.0
    assert abs(b.cv - round(sizes.std(ddof=1) / sizes.mean(), 4)) < 1e-12


def _dbscan_brute(x, eps, min_pts):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= min_pts
    lab = -np.ones(n, dtype=int)
    comp = 0
    for i in range(n):
        if not core[i] or lab[i] >= 0:
            continue
        stack = [i]
        lab[i] = comp
        while stack:
            j = stack.pop()
            for k in np.where(nb[j] & core)[0]:
                if lab[k] < 0:
                    lab[k] = comp
                    stack.append(k)
        comp += 1
    for i in range(n):
        if not core[i]:
            cands = [lab[k] for k in np.where(nb[i] & core)[0]]
            if cands:
                lab[i] = min(cands)
    return lab, core


@pytest.mark.parametrize("eps,min_pts", [(0.5, 5), (0.8, 10)])
def test_dbscan_matches_brute_force(spark, eps, min_pts):
    x, _ = _blobs(200, seed=3)
    x = np.vstack([x, [[10, 10, 10]], [[10.1, 10, 10]]])
    df = _points(spark, x)
    got = segment.dbscan(df, ["x0", "x1", "x2"], eps, min_pts).orderBy("row_id").toPandas().cluster.to_numpy()
    ref, _ = _dbscan_brute(x, eps, min_pts)
    assert np.array_equal(got, ref)


def test_eps_counts_partition_invariant(spark):
    x, _ = _blobs(150, seed=8)
    x = np.vstack([x, np.repeat([[1.0, 1.0, 1.0]], 60, axis=0)])      # a hot duplicated point
    df = _points(spark, x)
    a = segment.eps_neighbor_counts(df.repartition(1), ["x0", "x1", "x2"], 0.6).orderBy("row_id").toPandas()
    b = segment.eps_neighbor_counts(df.repartition(9), ["x0", "x1", "x2"], 0.6).orderBy("row_id").toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.array_equal(a.n_neighbors.to_numpy(), (d <= 0.6).sum(1))
    assert np.array_equal(a.n_neighbors.to_numpy(), b.n_neighbors.to_numpy())


def test_ward_on_micro_clusters(spark):
    x, lab = _blobs(90, seed=5)
    df = _points(spark, x)
    for n_micro in (20, 90):                            # fewer than and as many as the points
        labels, merges, used = segment.ward_micro(df, ["x0", "x1", "x2"], range(2, 5), n_micro)
        assert used <= n_micro and merges.count() == used - 1
        assert sorted(r.k for r in labels.select("k").distinct().collect()) == [2, 3, 4]
        l3 = labels.where("k = 3").orderBy("row_id").toPandas().cluster.to_numpy()
        cont = np.zeros((3, 3))
        for u, v in zip(lab, l3):
            cont[u, v] += 1
        assert (cont.max(1) == cont.sum(1)).all()          # well-separated blobs recovered


def _lloyd_brute(x, centers, tol):
    while True:
        near = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[near == j].mean(0) if (near == j).any() else centers[j] for j in range(len(centers))])
        moved = ((new - centers) ** 2).sum()
        centers = new
        if moved <= tol:
            return centers, ((x[:, None] - centers[None]) ** 2).sum(-1).min(1).sum()


@pytest.mark.parametrize("n_micro", [4096, 24])
def test_kmeans_matches_brute_force(spark, n_micro):
    """Every leaf a point, and leaves of many points, most of them settled."""
    x, _ = _blobs(400, seed=6)
    df, cols = _points(spark, x), ["x0", "x1", "x2"]
    rng, tol = np.random.default_rng(5), 1e-4 * x.var(0).mean()
    starts = {(k, i): x[rng.choice(len(x), k, replace=False)] for k in (2, 3, 5) for i in range(4)}
    starts[3, 4] = starts[3, 0][::-1].copy()              # the same start in another order
    fitted = segment.kmeans_fit(df, cols, [2, 3, 5], n_micro=n_micro, starts=dict(starts))
    for k in (2, 3, 5):
        want = min(_lloyd_brute(x, starts[r], tol)[1] for r in starts if r[0] == k)
        assert abs(fitted[k][1] - want) < 1e-6 and fitted[k][2]
    assert not segment.kmeans_fit(df, cols, [5], n_micro=n_micro, starts={(5, 0): starts[5, 0]}, max_iter=1)[5][2]


def test_kmeans_starts_are_plus_plus_over_all_rows(spark):
    x, _ = _blobs(150, seed=6)
    x = np.vstack([x, x[:30]])
    fitted = segment.kmeans_fit(_points(spark, x), ["x0", "x1", "x2"], [2, 4], n_init=6)
    u, w = np.unique(x, axis=0, return_counts=True)
    rng, tol = np.random.default_rng(validate.SEED), 1e-4 * x.var(0).mean()
    starts = {(k, i): kmeans.plus_plus(u, w.astype(float), k, rng) for k in (2, 4) for i in range(6)}
    for k in (2, 4):
        assert abs(fitted[k][1] - min(_lloyd_brute(x, starts[k, i], tol)[1] for i in range(6))) < 1e-6
    labels, inertia, centres = segment.kmeans_sweep(_points(spark, x), ["x0", "x1", "x2"], range(2, 5), n_init=4)
    for k in (2, 3, 4):
        assert labels.where(f"k = {k}").select("cluster").distinct().count() == k == len(centres[k])
    assert inertia[0][1] > inertia[1][1] > inertia[2][1]


def test_kmeans_leaves_rule_out_only_far_centres():
    """A settled leaf's points all have the same nearest centre."""
    rng = np.random.default_rng(3)
    leaves = kmeans.Leaves.__new__(kmeans.Leaves)
    mid = rng.uniform(-3, 3, (300, 2))
    size = rng.uniform(0, .5, (300, 2))
    leaves.lo, leaves.hi = mid - size, mid + size
    leaves.bounds()
    for _ in range(5):
        c = rng.uniform(-3, 3, (4, 2))
        near, slack = leaves.nearest(c)
        settled = slack > 0
        inside = leaves.lo[:, None] + rng.uniform(0, 1, (300, 60, 2)) * (leaves.hi - leaves.lo)[:, None]
        own = ((inside[:, :, None] - c) ** 2).sum(-1).argmin(-1)
        assert (own[settled] == near[settled, None]).all() and 20 < settled.sum() < 300


def test_kmeans_open_leaves_wait_until_centres_have_moved():
    """An open leaf is not looked at in every round, and the sums stay those of the settled leaves."""
    rng = np.random.default_rng(5)
    leaves = kmeans.Leaves.__new__(kmeans.Leaves)
    mid, size = rng.uniform(-3, 3, (400, 2)), rng.uniform(0, .4, (400, 2)) * (rng.random((400, 1)) < .8)
    leaves.lo, leaves.hi, leaves.n = mid - size, mid + size, rng.integers(1, 9, 400).astype(float)
    leaves.s, leaves.q = mid * leaves.n[:, None], (mid ** 2 + size ** 2) * leaves.n[:, None]
    leaves.features = [leaves.n, *leaves.s.T]
    leaves.bounds()
    looked, nearest = [], leaves.nearest
    leaves.nearest = lambda c, which=slice(None): (looked.append(len(which)), nearest(c, which))[1]
    start = kmeans._Start(rng.uniform(-3, 3, (4, 2)), leaves)
    for _ in range(12):
        got = start.look()
        near, slack = nearest(start.centers)
        want = (slack > 0) | leaves.point
        assert not (start.settled & ~want).any() and (start.near == near)[start.settled].all()
        for k in range(4):
            at = start.settled & (near == k)
            cost = (leaves.q - 2 * start.centers[k] * leaves.s + start.centers[k] ** 2 * leaves.n[:, None])[at].sum()
            assert np.allclose(got[k], [leaves.n[at].sum(), *leaves.s[at].sum(0), cost])
        assert np.array_equal(start.look(cost=False)[:, :-1], got[:, :-1])
        start.move(start.centers + rng.normal(scale=.002, size=(4, 2)))
    leaves.nearest(start.centers, np.arange(400))
    assert 20 < (~start.settled).sum() and max(looked[1:-1]) < (~start.settled).sum() / 2


def test_kmeans_sums_of_few_tasks_are_those_of_the_shuffle(spark):
    x, lab = _blobs(200, seed=8)
    rows = _points(spark, x, lab).select(F.col("cluster").cast("long").alias("_micro"), F.lit(2).cast("long").alias("_w"),
                                         "x0", "x1", "x2").repartition(5)
    cols = ["x0", "x1", "x2"]
    leaves = kmeans.Leaves(rows, cols)
    rng = np.random.default_rng(1)
    centers = {(k, 0): rng.uniform(0, 3, (k, 3)) for k in (2, 4)}
    open_ = {(2, 0): np.array([True, False, True]), (4, 0): np.array([True, True, True])}
    a, b = (kmeans._scan(rows, cols, leaves, centers, open_, few) for few in (True, False))
    for run, c in centers.items():
        some = x[np.isin(lab, np.flatnonzero(open_[run]))]
        near = ((some[:, None] - c) ** 2).sum(-1).argmin(1)
        assert np.allclose(a[run], b[run])
        assert np.array_equal(a[run][:, 0], 2 * np.bincount(near, minlength=len(c)))


def test_tree_reads_count_cells_by_sketches(spark, monkeypatch):
    """One binary value for each depth, not hundreds of columns."""
    def no(*_):
        raise AssertionError("counted with columns")

    monkeypatch.setattr(F, "approx_count_distinct", no)
    x, _ = _blobs(300, seed=4)
    _, c, w = ward.micro_clusters(_points(spark, x), ["x0", "x1", "x2"], n_micro=40, cells=64)
    assert len(c) == 40 and w.sum() == 300


@pytest.mark.parametrize("n", [130, 3000])
def test_dbscan_follows_long_chains(spark, n):
    x = np.column_stack([np.arange(n) * 0.9, np.zeros(n), np.zeros(n)])
    got = segment.dbscan(_points(spark, x), ["x0", "x1", "x2"], 1.0, 2)
    assert [r.cluster for r in got.select("cluster").distinct().collect()] == [0]


def test_dbscan_settings_share_a_pass(spark):
    x, _ = _blobs(160, seed=13)
    df = _points(spark, x)
    settings = [(0.3, 3), (0.5, 3), (0.5, 8)]
    got = segment.dbscan_settings(df, ["x0", "x1", "x2"], settings).toPandas()
    for eps, mp in settings:
        part = got[(got.eps == eps) & (got.min_pts == mp)].sort_values("row_id").cluster.to_numpy()
        assert np.array_equal(part, _dbscan_brute(x, eps, mp)[0])


def test_dense_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(segment, "CELL_POINTS", 16)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(scale=0.05, size=(200, 3)), rng.normal(loc=[0.9, 0, 0], scale=0.05, size=(200, 3)),
                   rng.uniform(-1, 2, size=(40, 3))])
    df = _points(spark, x)
    for eps, mp in ((0.7, 5), (0.85, 60)):
        got = segment.dbscan(df, ["x0", "x1", "x2"], eps, mp).orderBy("row_id").toPandas().cluster.to_numpy()
        assert np.array_equal(got, _dbscan_brute(x, eps, mp)[0])
    n = segment.eps_neighbor_counts(df, ["x0", "x1", "x2"], 0.85).orderBy("row_id").toPandas().n_neighbors
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.array_equal(n.to_numpy(), (d <= 0.85).sum(1))


@pytest.mark.parametrize("eps,min_pts", [(0.3, 2), (0.3, 3), (0.45, 4)])
def test_dbscan_chain_duplicates_and_noise(spark, eps, min_pts):
    rng = np.random.default_rng(21)
    t = np.arange(40) * 0.28                       # spacing just under ε: a chain of boundary links
    chain = np.column_stack([t, np.sin(t) * 0.5, np.zeros_like(t)])
    hot = np.repeat([[5.0, 5.0, 5.0]], 30, axis=0)   # one coordinate held by many rows
    noise = rng.uniform(-3, 12, size=(40, 3))
    blob = rng.normal(loc=[8, 0, 2], scale=0.15, size=(60, 3))
    x = np.vstack([chain, hot, noise, blob])
    df = _points(spark, x)
    got = segment.dbscan(df, ["x0", "x1", "x2"], eps, min_pts).orderBy("row_id").toPandas().cluster.to_numpy()
    ref, _ = _dbscan_brute(x, eps, min_pts)
    assert np.array_equal(got, ref)


def test_metrics_table(spark):
    from pyspark.sql import functions as F
    x, lab = _blobs(150, seed=12)
    pts = _points(spark, x, lab).drop("cluster")
    noisy = np.where(np.arange(150) % 7 == 0, -1, lab)         # a labeling with noise
    labelings = {2: lab % 2, 3: lab, 9: noisy}
    labs = None
    for k, l in labelings.items():
        part = _points(spark, x, l).select(F.lit("m").alias("method"), F.lit(k).alias("k"), "row_id", "cluster")
        labs = part if labs is None else labs.unionByName(part)
    tab = {r.k: r for r in validate.metrics_table(pts, ["x0", "x1", "x2"], labs, dunn_sample=100).collect()}
    for k, l in labelings.items():
        keep = l >= 0
        df = _points(spark, x[keep], l[keep])
        r = tab[k]
        assert r.sil == round(_silhouette_brute(x[keep], l[keep], squared=True), 4)
        assert r.db == round(validate.davies_bouldin(df, ["x0", "x1", "x2"]), 4)
        b = validate.balance(df).first()
        assert (r.cv, r.min_pct, r.max_pct) == (b.cv, b.min_pct, b.max_pct)
        assert r.n_dunn <= 100 and (k != 3 or r.n_dunn == 100)
        assert abs(r.score - (0.35 * r.sil + 0.25 * r.dunn + 0.25 / (1 + r.db) + 0.15 / (1 + r.cv))) < 2e-4


def test_edge_cases(spark):
    from tessera.operators import latent, ranks
    one = spark.createDataFrame([(1, 2)], "a long, b long")
    assert validate.adjusted_rand(one, "a", "b").first().ari == 1.0
    flat = spark.createDataFrame([(0, 3.0), (1, 3.0)], "row_id long, v double")
    assert [r.v for r in latent.zscore(flat, ["v"]).collect()] == [0.0, 0.0]
    gaps = spark.createDataFrame([(0, 1.0, None), (1, None, None), (2, 5.0, 2.0)], "row_id long, a double, b double")
    got = {r.row_id: (r.a, r.b) for r in ranks.rank_columns(gaps, ["a", "b"]).collect()}
    assert got == {0: (1.0, None), 1: (None, None), 2: (2.0, 1.0)}


def test_rank_columns_without_broadcast(spark, monkeypatch):
    from tessera.operators import ranks
    df = spark.createDataFrame([(i, float(i % 5), None if i % 3 else float(i)) for i in range(30)],
                               "row_id long, a double, b double")
    want = sorted(map(tuple, ranks.rank_columns(df, ["a", "b"]).collect()), key=str)
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, ranks.rank_columns(df, ["a", "b"]).collect()), key=str) == want


def test_row_ids_stay(spark, tmp_path):
    from tessera.operators import schema
    spark.range(50).selectExpr("concat('r', id) AS name").write.parquet(str(tmp_path / "raw"))
    df = schema.add_row_id(spark.read.parquet(str(tmp_path / "raw")))
    first = {r.name: r.row_id for r in df.collect()}
    assert first == {r.name: r.row_id for r in df.orderBy("name").collect()} and len(set(first.values())) == 50


def _kproto_brute(xn, xc, starts, gamma):
    """Rounds of assignment and update until the cost no longer falls: labels and their cost."""
    pn, pc, ids, prev = [s[0] for s in starts], [s[1] for s in starts], list(range(len(starts))), None
    while True:
        cost = np.stack([((xn - pn[j]) ** 2).sum(1) + gamma * (xc != np.array(pc[j], dtype=object)).sum(1)
                         for j in range(len(ids))], axis=1)
        near = cost.argmin(1)                     # ties: smaller cluster id, as ids are in order
        tot = cost[np.arange(len(xn)), near].sum()
        if prev is not None and prev - tot <= 1e-9 * max(1.0, abs(tot)):
            return np.array(ids)[near], tot
        prev = tot
        new_n, new_c, new_ids = [], [], []
        for j in range(len(ids)):
            m = near == j
            if m.any():
                new_ids.append(ids[j])
                new_n.append(xn[m].mean(0))
                new_c.append([sorted(zip(*(lambda v, c: (-c, v))(*np.unique(xc[m, q].astype(str), return_counts=True))))[0][1]
                              for q in range(xc.shape[1])])
        pn, pc, ids = new_n, new_c, new_ids


def test_kprototypes_matches_brute_force(spark):
    import hashlib
    rng = np.random.default_rng(31)
    n = 120
    xn = np.round(rng.normal(size=(n, 2)) + np.repeat([[0, 0], [3, 3], [0, 4]], 40, axis=0), 3)
    xc = np.array([[rng.choice(["a", "b"]), rng.choice(["u", "v", "w"])] for _ in range(n)], dtype=object)
    rows = [(i, float(xn[i, 0]), float(xn[i, 1]), str(xc[i, 0]), str(xc[i, 1])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, n0 double, n1 double, c0 string, c1 string")
    gamma = 0.5 * float(np.mean(xn.std(axis=0, ddof=1)))
    freq = [{v: (xc[:, q] == v).sum() / n for v in set(xc[:, q])} for q in range(2)]
    dens = np.array([sum(freq[q][xc[i, q]] for q in range(2)) for i in range(n)])
    chosen = []
    for _ in range(3):
        gain = dens * (np.min([(xc != xc[p]).sum(1) for p in chosen], axis=0) if chosen else 1)
        chosen.append(max(range(n), key=lambda i: (round(gain[i], 12), -i)))
    starts = [chosen]
    for init in (1,):
        starts.append(sorted(range(n), key=lambda i: hashlib.md5(f"{42 + init}{i}".encode()).hexdigest())[:3])
    best = min((_kproto_brute(xn, xc, [(xn[i], xc[i]) for i in s], gamma) for s in starts), key=lambda t: t[1])
    labels, costs = segment.kprototypes_sweep(df, ["n0", "n1"], ["c0", "c1"], [2, 3], n_init=2)
    got = labels.where("k = 3").orderBy("row_id").toPandas().cluster.to_numpy()
    cost = {k: c for k, c, _ in costs}[3]
    assert abs(cost - best[1]) < 1e-6 * max(1.0, best[1]) and all(done for _, _, done in costs)
    assert np.array_equal(got, best[0])


def test_ward_heights_match_lance_williams(spark):
    # independent Ward recurrence on squared distances (Lance–Williams update)
    rng = np.random.default_rng(17)
    x = rng.normal(size=(25, 3))
    merges = segment.ward_merges(x, np.ones(len(x)))
    n = len(x)
    d = {(i, j): float(((x[i] - x[j]) ** 2).sum()) for i in range(n) for j in range(i + 1, n)}
    size = {i: 1 for i in range(n)}
    active = set(range(n))
    heights = []
    nxt = n
    while len(active) > 1:
        (a, b), dab = min(((p, v) for p, v in d.items() if p[0] in active and p[1] in active), key=lambda t: t[1])
        heights.append(np.sqrt(dab))
        for c in active - {a, b}:
            dac = d[tuple(sorted((a, c)))]
            dbc = d[tuple(sorted((b, c)))]
            na, nb, nc = size[a], size[b], size[c]
            d[(c, nxt)] = ((na + nc) * dac + (nb + nc) * dbc - nc * dab) / (na + nb + nc)
        size[nxt] = size[a] + size[b]
        active = (active - {a, b}) | {nxt}
        nxt += 1
    assert np.allclose([m[3] for m in merges], heights, atol=1e-9)


def test_quantile_grid_shorter_than_column_count(spark):
    from tessera.operators import ranks
    import statistics
    x = np.array([3.0, 1.0, 2.0, 2.0, 5.0, 8.0, 13.0])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id long, x double")
    g = ranks.quantile_grid(df, ["x"], 1000)                   # m = min(n, 1000) = 7 references
    out = ranks.quantile_normal_transform(df, g, ["x"]).orderBy("row_id").toPandas().x.to_numpy()
    refs = np.linspace(0, 1, len(x))
    qs = np.percentile(x, refs * 100)
    # per value: NumPy's vectorised interp seeds its search with the previous
    # element, which makes values sitting on a repeated knot order-dependent
    p = np.array([0.5 * (np.interp(v, qs, refs) - np.interp(-v, -qs[::-1], -refs[::-1])) for v in x])
    p[x - 1e-7 < qs[0]] = 0
    p[x + 1e-7 > qs[-1]] = 1
    p = np.clip(p, 1e-7, 1 - 1e-7)
    assert np.allclose(out, [statistics.NormalDist().inv_cdf(v) for v in p], atol=1e-9)


@pytest.mark.parametrize("n_micro,cells", [(40, 1 << 16), (40, 64), (150, 300)])
def test_clustering_feature_tree(spark, n_micro, cells):
    """Leaves add up to the rows, also where the tree is read in several steps, and
    do not depend on the split of the rows."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(600, 3)), np.repeat([[2.0, 2.0, 2.0]], 50, axis=0),
                   1e-5 * rng.normal(size=(200, 3)) + 5.0])
    out = []
    for parts in (1, 7):
        rows, c, w = ward.micro_clusters(_points(spark, x).repartition(parts), ["x0", "x1", "x2"], n_micro, cells)
        got = rows.orderBy("row_id").toPandas()._micro.to_numpy()
        assert len(c) == n_micro == len(np.unique(got)) and w.sum() == len(x)
        for j in range(n_micro):
            assert np.allclose(x[got == j].mean(0), c[j], atol=1e-9) and (got == j).sum() == w[j]
        out.append(got)
    assert np.array_equal(*out)
    error = sum(((x[out[0] == j] - x[out[0] == j].mean(0)) ** 2).sum() for j in range(n_micro))
    assert error < 0.25 * ((x - x.mean(0)) ** 2).sum()


def test_ward_chain_with_weights_and_ties():
    """The chain's merges are those of the greedy rule, also with equal distances."""
    rng = np.random.default_rng(23)
    for x, w in ((rng.normal(size=(60, 2)), rng.integers(1, 9, 60)), (rng.integers(0, 4, (40, 2)) * 1.0, np.ones(40))):
        merges = ward.ward_merges(x, w)
        c, size, heights = {i: v for i, v in enumerate(x)}, dict(enumerate(w.astype(float))), []
        for step in range(len(x) - 1):
            cost, a, b = min((size[a] * size[b] / (size[a] + size[b]) * ((c[a] - c[b]) ** 2).sum(), a, b)
                             for a in c for b in c if a < b)
            heights.append(np.sqrt(2 * cost))
            n = size[a] + size[b]
            c[len(x) + step] = (c.pop(a) * size[a] + c.pop(b) * size[b]) / n
            size[len(x) + step] = n
        if len(np.unique(np.round(heights, 9))) == len(heights):
            assert np.allclose([m[3] for m in merges], heights)
        assert merges[-1][4] == w.sum() and sorted(m[3] for m in merges) == [m[3] for m in merges]
        assert sorted(y for m in merges for y in m[1:3]) == list(range(2 * len(x) - 2))


@pytest.mark.parametrize("gap", [0.995, 1.005])
def test_dense_walls_are_linked_by_splitting(spark, gap):
    """Two dense walls that face each other just within and just beyond ε."""
    rng = np.random.default_rng(1)
    wall = rng.uniform(0, 1.2, (3000, 2))
    x = np.vstack([np.column_stack([np.zeros(3000), wall]), np.column_stack([np.full(3000, gap), wall + 1e-3])])
    got = segment.dbscan(_points(spark, x), ["x0", "x1", "x2"], 1.0, 4)
    n = got.select("cluster").distinct().count()
    assert n == (1 if gap < 1 else 2) and got.where("cluster < 0").count() == 0


def test_kmeans_rounds_have_no_list_of_leaves_in_their_plans(spark, monkeypatch):
    """Thousands of literals took ten seconds a round; equal rows count by their number."""
    def refused(*_):
        raise AssertionError("a list of leaves in a plan")

    monkeypatch.setattr(type(F.col("x")), "isin", refused)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(400, 3)), rng.integers(1, 5, 400), axis=0)
    start = x[[0, 300, 600]]
    fitted = segment.kmeans_fit(_points(spark, x), ["x0", "x1", "x2"], [3], n_micro=32, starts={(3, 0): start})
    want = _lloyd_brute(x, start, 1e-4 * float(np.mean(x.var(0))))[1]
    assert abs(fitted[3][1] - want) < 1e-6 and fitted[3][2]


def test_eps_neighbours_are_joined_without_broadcast(spark, monkeypatch):
    """Points times neighbour cells looked as small as the points and went through the driver."""
    monkeypatch.setattr(segment, "CELL_POINTS", 16)        # boxes are split
    x = np.random.default_rng(3).normal(size=(500, 3)) * 0.6
    got = segment.eps_neighbor_counts(_points(spark, np.vstack([x, x[:50]])), ["x0", "x1", "x2"], 0.4)
    rows = got.orderBy("row_id").toPandas()
    every = np.vstack([x, x[:50]])
    d = np.sqrt(((every[:, None] - every[None]) ** 2).sum(-1))
    assert rows.n_neighbors.tolist() == (d <= 0.4).sum(1).tolist()
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    labels = segment.dbscan(_points(spark, x), ["x0", "x1", "x2"], 0.25, 4).orderBy("row_id").toPandas().cluster
    assert np.array_equal(labels.to_numpy(), _dbscan_brute(x, 0.25, 4)[0])


def test_kprototypes_rounds_read_equal_answers_once(spark, monkeypatch):
    """A round sorted all rows once for each start and column; equal answers are one row."""
    seen, was = [], segment._mixed_round

    def counted(base, *rest):
        seen.append(base.count())
        return was(base, *rest)

    monkeypatch.setattr(segment, "_mixed_round", counted)
    rng = np.random.default_rng(8)
    num, cat = rng.integers(1, 4, 300).astype(float), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, float(a), "abc"[b]) for i, (a, b) in enumerate(zip(num, cat))], "row_id long, n double, c string")
    labels, cost = segment.kprototypes(df, ["n"], ["c"], 3, gamma=0.7)
    assert set(seen) == {len({*zip(num, cat)})}
    got = labels.orderBy("row_id").toPandas().cluster.to_numpy()
    total = 0.0
    for k in set(got):
        x, c = num[got == k], cat[got == k]
        total += ((x - x.mean()) ** 2).sum() + 0.7 * (len(c) - np.bincount(c).max())
    assert abs(total - cost) < 1e-6


def test_silhouette_sums_a_few_distances_at_a_time():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(70, 3)), rng.normal(size=(90, 3))
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)).sum(1)
    for cells in (1, 200, 1 << 17):
        assert np.allclose(validate.distance_sums(x, y, cells), want, rtol=1e-12)


def test_box_summary_leaves_values_where_they_are(spark):
    """The fences go to the values; joined by a shuffle all values of a column met in one task."""
    from tessera.operators import profile

    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        b = profile.box_summary(spark.createDataFrame([(float(i),) for i in [*range(1, 101), 900]], "v double"), ["v"])
        row = b.first()
        assert (row["n"], row["n_outliers"], row["median"]) == (101, 1, 51.0)
        assert "BroadcastHashJoin" in b._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, was)


def test_weighted_points_count_as_their_rows(spark):
    """Metrics, k-means, Ward and DBSCAN of weighted points are those of the rows."""
    from pyspark.sql import functions as F
    from tessera.plans import flows
    cols = ["x0", "x1", "x2"]
    x, lab = _blobs(60, seed=5)
    w = np.random.default_rng(0).integers(1, 6, len(x))
    rows = _points(spark, np.repeat(x, w, axis=0), np.repeat(lab, w))
    schema = "row_id long, x0 double, x1 double, x2 double, cluster long, _w long"
    first = np.r_[0, np.cumsum(w)[:-1]]
    points = spark.createDataFrame([(int(i), *map(float, p), int(c), int(n)) for i, p, c, n in zip(first, x, lab, w)], schema)

    one = rows.select(F.lit(3).alias("k"), "row_id", "cluster")
    of_rows = validate.metrics_table(rows.drop("cluster"), cols, one, "row_id", ("k",)).first()
    long = points.select(F.lit(3).alias("k"), "cluster", *cols, "_w")
    assert validate.labelled_metrics(long, cols, long, ["k"], "_w").drop("n_dunn").first() == tuple(
        of_rows[c] for c in of_rows.__fields__ if c != "n_dunn")

    starts = {(3, 0): x[:3]}
    a = segment.kmeans_fit(rows, cols, [3], starts=dict(starts))[3]
    b = segment.kmeans_fit(points, cols, [3], starts=dict(starts), weight="_w")[3]
    assert np.allclose(a[0], b[0]) and abs(a[1] - b[1]) < 1e-9

    for n_micro in (4096, 20):
        leaves_of, cuts, merges, m = segment.ward_fit(points, cols, [3], n_micro, weight="_w")
        labels, of_all, used = segment.ward_micro(rows, cols, [3], n_micro)
        assert m == used and np.allclose([r[3:] for r in merges], [tuple(r)[3:] for r in of_all.orderBy("step").collect()])
        got = leaves_of(rows).withColumn("cluster", segment.leaf_label(cuts[3])).select("row_id", "cluster")
        assert sorted(map(tuple, got.collect())) == sorted((r.row_id, r.cluster) for r in labels.collect())

    grid = [(0.6, 5), (1.5, 12)]
    want = flows.dbscan_summary(rows.drop("cluster"), cols, grid).orderBy("eps").collect()
    assert flows.dbscan_summary(points.drop("cluster"), cols, grid, "row_id", "_w").orderBy("eps").collect() == want


def test_tree_reads_look_cells_up_at_once(spark, monkeypatch):
    """The cells below all nodes are found by one search, not by one for every node."""
    from tessera.operators import ward
    calls, search = [], np.searchsorted

    def counted(a, v, *args, **options):
        calls.append(np.size(v))
        return search(a, v, *args, **options)

    x, _ = _blobs(400, seed=1)
    monkeypatch.setattr(ward.np, "searchsorted", counted)
    ward.leaf_tree(_points(spark, x), ["x0", "x1", "x2"], n_micro=60, cells=64)
    assert len(calls) < 60


@pytest.mark.parametrize("held", [4, 1 << 19])
def test_nearby_edges_are_contracted_where_they_are(spark, monkeypatch, held):
    """Chains within partitions reach the star rounds only by the nodes that partitions share."""
    from tessera.operators import graph
    n, parts = 400, 4
    chain = [(i, i + 1) for i in range(n - 1) if i != 250] + [(n, n)]
    edges = spark.createDataFrame(chain, "a long, b long").coalesce(1).repartitionByRange(parts, "a")
    asked, whole = [], graph.components

    def counted(links):
        asked.append(links.count())
        return whole(links)

    monkeypatch.setattr(graph, "components", counted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r.node: r.component for r in graph.components_nearby(edges, held).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: 0 if i <= 250 else 251 if i < n else n for i in range(n + 1)}
    assert (asked[0] < parts) == (held > n)


def test_dbscan_meets_every_pair_of_cells_once(spark, monkeypatch):
    """Of an offset and its opposite one is followed; edges between cells are not written."""
    full, partial = segment._offsets(3, 1 / (2 * 3 ** 0.5) * segment._INSIDE)
    for offsets in (full, partial):
        half = segment._half(offsets)
        assert set(half) | {tuple(-v for v in o) for o in half} == {o for o in offsets if any(o)}
        assert len(half) == sum(any(o) for o in offsets) // 2
    names, write = [], segment.saved
    monkeypatch.setattr(segment, "saved", lambda df, name: (names.append(name), write(df, name))[1])
    x = _blobs(150, seed=4)[0]
    got = segment.dbscan(_points(spark, x), ["x0", "x1", "x2"], 0.5, 4).orderBy("row_id").toPandas().cluster
    assert np.array_equal(got, _dbscan_brute(x, 0.5, 4)[0]) and "edges" not in names
