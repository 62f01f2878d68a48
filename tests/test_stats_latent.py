"""Rank statistics and latent operators against brute-force numpy/pandas."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.stats import inv_normal_np
from tessera.operators import latent, ranks


def _kw_brute(groups):
    allv = np.concatenate(groups)
    r = pd.Series(allv).rank().to_numpy()
    n = len(allv)
    h, start = 0.0, 0
    for g in groups:
        rg = r[start:start + len(g)]
        start += len(g)
        h += rg.sum() ** 2 / len(g)
    h = 12.0 / (n * (n + 1)) * h - 3 * (n + 1)
    _, counts = np.unique(allv, return_counts=True)
    c = 1 - (counts ** 3 - counts).sum() / (n ** 3 - n)
    return h / c


def test_chi2_tail_table_values(spark):
    crit = {1: 3.841458820694124, 2: 5.991464547107979, 3: 7.814727903251179, 4: 9.487729036781154,
            15: 24.99579013972863}
    df = spark.createDataFrame([(float(x), k) for k, x in crit.items()], "x double, k int")
    from tessera.functions.stats import chi2_sf
    out = df.select("k", chi2_sf(F.col("x"), F.col("k")).alias("p")).collect()
    for r in out:
        assert abs(r.p - 0.05) < 1e-6
    for k, x in crit.items():
        assert abs(latent.chi2_sf_py(x, k) - 0.05) < 1e-9


def test_inverse_normal_matches_stdlib():
    ps = np.array([1e-7, 1e-4, 0.01, 0.2, 0.5, 0.7, 0.975, 0.999999])
    z = inv_normal_np(ps)
    for p, v in zip(ps, z):
        assert abs(v - statistics.NormalDist().inv_cdf(p)) < 1e-12


def test_kruskal_wallis_matches_brute_force(spark):
    rng = np.random.default_rng(42)
    rows = [(int(g), float(rng.integers(1, 6))) for g in rng.integers(0, 3, 300)]
    df = spark.createDataFrame(rows, "g long, x double")
    kw = ranks.kruskal_wallis(df, ["x"], "g").first()
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    h = _kw_brute([pdf[pdf.g == k].x.to_numpy() for k in sorted(pdf.g.unique())])
    assert abs(kw.h - h) < 1e-9
    assert abs(kw.p_value - math.exp(-h / 2)) < 1e-9     # 3 groups → df 2


def test_kruskal_invariant_to_partitioning(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 4, 500), rng.normal(size=500).round(1))]
    df = spark.createDataFrame(rows, "g long, x double")
    a = ranks.kruskal_wallis(df.repartition(1), ["x"], "g", buckets=4).first()
    b = ranks.kruskal_wallis(df.repartition(7), ["x"], "g", buckets=64).first()
    assert abs(a.h - b.h) < 1e-9 and a.n == b.n == 500


def test_average_ranks_match_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, 400).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id long, x double")
    rk = ranks.rank_columns(df, ["x"], "row_id").orderBy("row_id").toPandas()
    assert np.allclose(rk.x.to_numpy(), pd.Series(x).rank().to_numpy())


@pytest.mark.parametrize("accuracy,bracket", [(10000, 1 << 16), (20, 1 << 16), (20, 5)])
def test_exact_quantiles_match_numpy(spark, accuracy, bracket):
    """Also with brackets much wider than a position, ordered in ranges."""
    rng = np.random.default_rng(11)
    groups = {"a": np.concatenate([rng.normal(size=300).round(2), np.full(200, 0.5)]), "b": rng.exponential(size=777),
              None: np.array([3.0]), "c": np.array([1.0, 2.0]), "d": np.full(50, -1.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, val double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = {(r.g, r.j): r.q for r in ranks.exact_quantiles(df, ["g"], probs, accuracy=accuracy, bracket=bracket).collect()}
    assert len(got) == len(groups) * len(probs)
    for g, x in groups.items():
        assert np.allclose([got[g, j] for j in range(len(probs))], np.percentile(x, [p * 100 for p in probs]), atol=1e-12)


def test_group_summary_shares_one_sort(spark):
    rng = np.random.default_rng(4)
    rows = [(str(rng.choice(["u", "v", "w"])) if i % 9 else None, float(rng.integers(0, 6)),
             float(rng.normal()) if i % 4 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    stats, tests = ranks.group_summary(df, ["a", "b"], "g")
    pdf = pd.DataFrame(rows, columns=["g", "a", "b"]).dropna(subset=["g"])
    got = {(r["var"], r.g): r for r in stats.collect()}
    for c in ("a", "b"):
        for g, x in pdf.dropna(subset=[c]).groupby("g")[c]:
            r = got[c, g]
            assert r.n == len(x) and np.allclose([r.mean, r.median, r["std"], r.min, r.max],
                                                 [x.mean(), x.median(), x.std(), x.min(), x.max()])
    want = {r["var"]: r for r in ranks.kruskal_wallis(df, ["a", "b"], "g").collect()}
    for r in tests.collect():
        w = want[r["var"]]
        assert (r.n, r.n_groups, r.df) == (w.n, w.n_groups, w.df) and abs(r.h - w.h) < 1e-9 and abs(r.p_value - w.p_value) < 1e-9


def test_moments_of_many_columns_in_one_aggregate(spark):
    """109 columns, far from zero, with gaps: numpy's matrices, one aggregation."""
    from tessera.operators import gram, profile
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 109)) @ rng.normal(size=(109, 109)) * 1e-2 + 1e6
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 7] = 5.0
    cols = [f"c{i}" for i in range(109)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(6)
    m, means, n = gram.moments(df, cols, "corr")
    want = pd.DataFrame(x).corr().to_numpy()
    off = ~np.eye(109, dtype=bool)
    assert np.allclose(m[off], want[off], atol=1e-9, equal_nan=True) and np.isnan(m[7, 8])
    assert np.allclose(means, np.nanmean(x, axis=0)) and n == 300
    cov, _, _ = gram.moments(df, cols, "cov")
    assert np.allclose(cov, pd.DataFrame(x).cov().to_numpy(), rtol=1e-8, atol=1e-9)
    plan = profile.corr_pairs(df, cols)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate(") == 2                 # one aggregate: partial and final


def test_mca_by_subspace_iteration(spark):
    """More categories than the block has columns; the answers' patterns have structure."""
    rng = np.random.default_rng(14)
    trait = rng.normal(size=900)
    df = pd.DataFrame({c: [f"{c}{int(v)}" for v in np.clip((trait * w + rng.normal(size=900)) * 4 + 15, 0, 30)]
                       for c, w in (("a", 2.0), ("b", 1.5), ("c", 1.0))})
    frame = spark.createDataFrame(df.assign(row_id=range(900)))
    exact = latent.fit_mca(frame, ["a", "b", "c"], 2, block=1000)
    m = latent.fit_mca(frame, ["a", "b", "c"], 2, block=12)
    assert len(m.categories) > 60
    z = pd.get_dummies(df).to_numpy(dtype=float)
    p = z / z.sum()
    s = (p - np.outer(p.sum(1), p.sum(0))) / np.sqrt(np.outer(p.sum(1), p.sum(0)))
    sv = np.linalg.svd(s, compute_uv=False)
    assert np.allclose(exact.eigenvalues, sv[:2] ** 2, atol=1e-10) and np.allclose(m.eigenvalues, sv[:2] ** 2, atol=1e-9)
    assert np.allclose(m.cat_scores, exact.cat_scores, atol=1e-4)


def test_singular_blocks_are_told(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 60))
    df = spark.createDataFrame([(i, float(u), float(u), float(v), 1.0) for i, (u, v) in enumerate(zip(a, b))],
                               "row_id long, a double, twin double, b double, flat double")
    latent.fit_factor_block(df, ["a", "b"])
    for cols in (["a", "twin", "b"], ["a", "b", "flat"]):
        with pytest.raises(latent.SingularBlock):
            latent.fit_factor_block(df, cols)


def test_group_density_equals_the_direct_sum(spark):
    from tessera.operators import profile
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=900) * 3, "b": np.concatenate([rng.exponential(size=300), [40.0]]), "c": np.full(5, 2.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), (None, 1.0)]
    out = profile.group_density(spark.createDataFrame(rows, "seg string, x double").repartition(4), "x", "seg", 40).collect()
    every = np.concatenate(list(groups.values()))
    grid = np.linspace(every.min(), every.max(), 40)
    assert sorted({r[0] for r in out}) == ["a", "b"] and len(out) == 80
    for g in ("a", "b"):
        x = groups[g]
        h = x.std(ddof=1) * len(x) ** -0.2
        want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / np.sqrt(2 * np.pi) / (len(x) * h)
        got = [r[3] for r in sorted(out, key=lambda r: r[1]) if r[0] == g]
        assert np.allclose(got, want, rtol=0, atol=1e-8 / h)


def test_lumps_share_a_pass(spark):
    from tessera.operators import encode
    df = spark.createDataFrame([(i, " a " if i % 2 else "B", None if i % 5 == 0 else f"v{i % 4}") for i in range(40)],
                               "row_id long, x string, y string")
    both = encode.lump_many(df, [("x", 25, "Otro"), ("y", 9, "Otro")])
    one = encode.lump_rare(encode.lump_rare(df, "x", 25), "y", 9)
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    assert {r.x for r in both.collect()} == {"Otro"} and "V1" not in {r.y for r in both.collect()}


def test_quantile_normal_matches_reference_algorithm(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=400), np.full(100, 1.0)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id long, x double")
    g = ranks.quantile_grid(df, ["x"], 100)
    out = ranks.quantile_normal_transform(df, g, ["x"]).orderBy("row_id").toPandas().x.to_numpy()
    # brute force: sklearn-style quantile transform written with numpy
    refs = np.linspace(0, 1, 100)
    qs = np.percentile(x, refs * 100)
    fwd = np.array([np.interp(v, qs, refs) for v in x])            # per value (order-independent)
    bwd = np.array([-np.interp(-v, -qs[::-1], -refs[::-1]) for v in x])
    p = 0.5 * (fwd + bwd)
    p[x - 1e-7 < qs[0]] = 0
    p[x + 1e-7 > qs[-1]] = 1
    p = np.clip(p, 1e-7, 1 - 1e-7)
    ref = np.array([statistics.NormalDist().inv_cdf(v) for v in p])
    assert np.allclose(out, ref, atol=1e-9)


def test_kmo_bartlett_and_factor(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=400)
    data = np.column_stack([f + rng.normal(scale=s, size=400) for s in (0.5, 0.7, 0.9, 1.1)])
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], ["row_id", *cols])
    r = np.corrcoef(data, rowvar=False)
    k, _ = latent.kmo(r)
    assert 0 <= k <= 1
    chi2, dof, p = latent.bartlett_sphericity(r, 400)
    assert dof == 6 and chi2 > 0 and p < 1e-6
    m = latent.fit_factor_block(df, cols, 1, "blk")
    w, v = np.linalg.eigh(r)
    load = np.abs(v[:, -1]) * math.sqrt(w[-1])
    assert np.allclose(np.abs(m.loadings[:, 0]), load, atol=1e-9)
    assert m.loadings[:, 0].sum() > 0
    sc = df.select(*m.score_columns()).toPandas().iloc[:, 0].to_numpy()
    z = (data - data.mean(0)) / data.std(0)
    assert np.allclose(sc, z @ np.linalg.solve(r, m.structure[:, 0]), atol=1e-8)


def test_mca_matches_indicator_svd(spark):
    rng = np.random.default_rng(9)
    a = rng.choice(["x", "y", "z"], 200)
    b = np.where(rng.random(200) < 0.7, a, rng.choice(["p", "q"], 200))
    df = spark.createDataFrame([(i, str(u), str(v)) for i, (u, v) in enumerate(zip(a, b))], "row_id long, a string, b string")
    m = latent.fit_mca(df, ["a", "b"], 2)
    coords = df.orderBy("row_id").select(*m.coord_columns()).toPandas().to_numpy()
    z = pd.get_dummies(pd.DataFrame({"a": a, "b": b})).to_numpy(dtype=float)
    p = z / z.sum()
    r, c = p.sum(1), p.sum(0)
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    u, sv, vt = np.linalg.svd(s, full_matrices=False)
    f = (u * sv) / np.sqrt(r)[:, None]
    for k in range(2):
        assert np.allclose(np.abs(coords[:, k]), np.abs(f[:, k]), atol=1e-8)
        assert abs(m.eigenvalues[k] - sv[k] ** 2) < 1e-10


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0.5, 0.2]])
    cols = ["a", "b", "c"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], cols)
    m = latent.fit_pca(df, cols, 3)
    xc = x - x.mean(0)
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    ratio = s ** 2 / (s ** 2).sum()
    assert np.allclose(m.explained_ratio, ratio, atol=1e-10)
    for k in range(3):
        assert np.allclose(np.abs(m.components[:, k]), np.abs(vt[k]), atol=1e-8)


def test_median_and_mode_impute(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "b"), (4.0, None), (3.0, "a")], "x double, c string")
    out = latent.mode_impute(latent.median_impute(df, ["x"]), ["c"]).collect()
    assert [r.x for r in out] == [1.0, 2.0, 2.5, 4.0, 3.0]
    assert out[3].c == "a"                  # tie a/b → smallest value
