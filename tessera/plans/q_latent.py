"""Latent-dimension queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.stats import chi2_sf_sql, inv_normal_sql, kmo_label_sql
from tessera.operators import latent, profile, ranks
from tessera.plans.catalog import register, r6, sql_long
from tessera.plans.proxies import (DOC_COLS, DOC_METRICS_SQL, EMBED_DIMS, SURVEY_SQL, doc_metrics, embed_columns,
                                   embed_points, embed_points_sql, survey)
from tessera.sources.tables import load

_MED_COLS = ["q1", "q2", "q4"]


@register("median_impute", f"""WITH {SURVEY_SQL}
SELECT row_id, {', '.join(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM survey)) AS {c}'
                          for c in _MED_COLS)} FROM survey""")
def median_impute(spark, sf_dir):
    """Nulls → exact column median."""
    s = survey(spark, sf_dir).select("row_id", *_MED_COLS)
    return latent.median_impute(s, _MED_COLS)


@register("mode_impute", f"""WITH {SURVEY_SQL},
m AS (SELECT var, arg_min(val, (-cnt, val)) AS mode FROM (
        SELECT 'b2' AS var, b2 AS val, count(*) AS cnt FROM survey WHERE b2 IS NOT NULL GROUP BY b2
        UNION ALL SELECT 't1', t1, count(*) FROM survey WHERE t1 IS NOT NULL GROUP BY t1) GROUP BY var)
SELECT row_id, coalesce(b2, (SELECT mode FROM m WHERE var = 'b2')) AS b2,
       coalesce(t1, (SELECT mode FROM m WHERE var = 't1')) AS t1 FROM survey""")
def mode_impute(spark, sf_dir):
    """Nulls → most frequent answer (ties → smallest)."""
    s = survey(spark, sf_dir).select("row_id", "b2", "t1")
    return latent.mode_impute(s, ["b2", "t1"])


@register("zscore", """SELECT o_orderkey,
  round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS z FROM orders""")
def zscore(spark, sf_dir):
    """Z-score with the population standard deviation."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    z = latent.zscore(o, ["o_totalprice"], "_z")
    return z.select("o_orderkey", r6("o_totalprice_z").alias("z"))


def _spearman_cte():
    rk = ",\n  ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0E0 AS {c}"
                      for c in DOC_COLS)
    return f"""{DOC_METRICS_SQL},
rk AS (SELECT {rk} FROM docm),
rr AS (SELECT count(*) AS n, corr(n_chars, n_words) AS a, corr(n_chars, n_lines) AS b,
              corr(n_words, n_lines) AS c FROM rk)"""


_KMO_SQL = f"""WITH {_spearman_cte()},
pq AS (SELECT n, a, b, c,
              (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS qa,
              (b - a * c) / sqrt((1 - a * a) * (1 - c * c)) AS qb,
              (c - a * b) / sqrt((1 - a * a) * (1 - b * b)) AS qc,
              1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM rr),
k AS (SELECT n, (a * a + b * b + c * c) / (a * a + b * b + c * c + qa * qa + qb * qb + qc * qc) AS kmo,
             -(n - 1 - (2 * 3 + 5) / 6.0E0) * ln(det) AS chi2 FROM pq)
SELECT 'docs' AS block, CAST(n AS BIGINT) AS n, round(kmo, 6) AS kmo, {kmo_label_sql('kmo')} AS kmo_label,
       round(chi2, 6) AS chi2, CAST(3 AS BIGINT) AS df, round({chi2_sf_sql('chi2', 3)}, 6) AS p_value FROM k"""


@register("kmo_bartlett", _KMO_SQL)
def kmo_bartlett(spark, sf_dir):
    """M4–M7: Spearman matrix of the document-metrics block → KMO and Bartlett."""
    d = doc_metrics(spark, sf_dir)
    r, n = latent.spearman_matrix(d, DOC_COLS)
    k, _ = latent.kmo(r)
    chi2, dof, p = latent.bartlett_sphericity(r, n)
    row = [("docs", n, round(k, 6), latent.kmo_label(k), round(chi2, 6), dof, round(p, 6))]
    return spark.createDataFrame(row, "block string, n long, kmo double, kmo_label string, chi2 double, "
                                      "df long, p_value double")


def _doc_factor(spark, sf_dir):
    d = doc_metrics(spark, sf_dir)
    rk = ranks.rank_columns(latent.median_impute(d, DOC_COLS), DOC_COLS, "row_id")
    return rk, latent.fit_factor_block(rk, DOC_COLS, 1, "docs")


def _factor_scores_sql():
    rk = ",\n  ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0E0 AS {c}"
                       for c in DOC_COLS)
    return f"""WITH {DOC_METRICS_SQL},
rk AS (SELECT row_id, {rk} FROM docm),
rr AS (SELECT corr(n_chars, n_words) AS a, corr(n_chars, n_lines) AS b, corr(n_words, n_lines) AS c,
              avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(n_words) AS m2, stddev_pop(n_words) AS s2,
              avg(n_lines) AS m3, stddev_pop(n_lines) AS s3 FROM rk),
ev AS (SELECT *, sqrt((a * a + b * b + c * c) / 3.0E0) AS pp FROM rr),
ev3 AS (SELECT *, 1.0E0 + 2 * pp * cos(acos(greatest(-1.0E0, least(1.0E0, a * b * c / (pp * pp * pp)))) / 3.0E0)
                 AS lam FROM ev),
v AS (SELECT *, a * c - b * (1 - lam) AS v1, b * a - (1 - lam) * c AS v2, (1 - lam) * (1 - lam) - a * a AS v3
      FROM ev3),
nv AS (SELECT *, sqrt(v1 * v1 + v2 * v2 + v3 * v3) AS nrm FROM v),
sg AS (SELECT *, CASE WHEN v1 + v2 + v3 < 0 THEN -1 ELSE 1 END AS sgn FROM nv)
SELECT row_id, round(sgn / nrm / sqrt(lam) * (v1 * (n_chars - m1) / s1 + v2 * (n_words - m2) / s2
                                              + v3 * (n_lines - m3) / s3), 6) AS docs_F1
FROM rk, sg"""


@register("factor_scores", _factor_scores_sql())
def factor_scores(spark, sf_dir):
    """M8: one-factor principal extraction on ranks, regression scores per row
    (oracle: weights R⁻¹·√λ·u = u/√λ with the 3×3 closed-form eigenpair)."""
    rk, m = _doc_factor(spark, sf_dir)
    return rk.select("row_id", *[r6(c).alias("docs_F1") for c in m.score_columns()])


@register("factor_scores_2f")
def factor_scores_2f(spark, sf_dir):
    """M8 with two oblimin-rotated factors over a 4-item survey block."""
    s = survey(spark, sf_dir)
    items = ["q1", "q2", "q3", "q4"]
    v = latent.median_impute(s.select("row_id", *items), items)
    rk = ranks.rank_columns(v, items, "row_id")
    m = latent.fit_factor_block(rk, items, 2, "survey")
    return rk.select("row_id", *m.score_columns())


_LOADINGS_SQL = f"""WITH {_spearman_cte()},
ev AS (SELECT *, sqrt((a * a + b * b + c * c) / 3.0E0) AS pp FROM rr),
ev3 AS (SELECT *, 1.0E0 + 2 * pp * cos(acos(greatest(-1.0E0, least(1.0E0, a * b * c / (pp * pp * pp)))) / 3.0E0)
                 AS lam FROM ev),
v AS (SELECT lam, a * c - b * (1 - lam) AS v1, b * a - (1 - lam) * c AS v2, (1 - lam) * (1 - lam) - a * a AS v3
      FROM ev3),
nv AS (SELECT lam, v1 / sqrt(v1 * v1 + v2 * v2 + v3 * v3) AS u1, v2 / sqrt(v1 * v1 + v2 * v2 + v3 * v3) AS u2,
              v3 / sqrt(v1 * v1 + v2 * v2 + v3 * v3) AS u3 FROM v),
sg AS (SELECT lam, u1, u2, u3, CASE WHEN u1 + u2 + u3 < 0 THEN -1 ELSE 1 END AS s FROM nv),
l AS (SELECT 'n_chars' AS var, round(s * u1 * sqrt(lam), 3) AS loading FROM sg
      UNION ALL SELECT 'n_words', round(s * u2 * sqrt(lam), 3) FROM sg
      UNION ALL SELECT 'n_lines', round(s * u3 * sqrt(lam), 3) FROM sg)
SELECT 'docs' AS block, var, 1 AS factor, loading, rank FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY abs(loading) DESC, var) AS INTEGER) AS rank FROM l
  WHERE abs(loading) > 0.5) WHERE rank <= 3"""


@register("strong_loadings", _LOADINGS_SQL)
def strong_loadings(spark, sf_dir):
    """M9: loadings above 0.5 in absolute value, top 3 per factor."""
    _, m = _doc_factor(spark, sf_dir)
    return latent.strong_loadings([m], spark)


# largest eigenvalue of the symmetric 3×3 rank-correlation matrix (trigonometric
# closed form) → % variance of the single principal factor = λ₁ / 3
_FACTOR_SUMMARY_SQL = f"""WITH {_spearman_cte()},
pq AS (SELECT n, a, b, c,
              (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS qa,
              (b - a * c) / sqrt((1 - a * a) * (1 - c * c)) AS qb,
              (c - a * b) / sqrt((1 - a * a) * (1 - b * b)) AS qc,
              1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM rr),
ev AS (SELECT *, sqrt((a * a + b * b + c * c) / 3.0E0) AS pp FROM pq),
ev2 AS (SELECT *, (2 * a * b * c) / (pp * pp * pp) / 2.0E0 AS rr2 FROM ev),
ev3 AS (SELECT *, 1.0E0 + 2 * pp * cos(acos(greatest(-1.0E0, least(1.0E0, rr2))) / 3.0E0) AS lam FROM ev2),
k AS (SELECT n, lam, (a * a + b * b + c * c) / (a * a + b * b + c * c + qa * qa + qb * qb + qc * qc) AS kmo,
             -(n - 1 - (2 * 3 + 5) / 6.0E0) * ln(det) AS chi2 FROM ev3)
SELECT 'docs' AS block, CAST(n AS BIGINT) AS n, round(kmo, 6) AS kmo, {kmo_label_sql('kmo')} AS kmo_label,
       round({chi2_sf_sql('chi2', 3)}, 6) AS bartlett_p, 1 AS n_factors, round(lam / 3.0E0 * 100, 2) AS variance_pct,
       3 AS n_vars FROM k"""


@register("factor_summary", _FACTOR_SUMMARY_SQL)
def factor_summary(spark, sf_dir):
    """M8 report: KMO, label, Bartlett p, factors, % variance per block."""
    _, m = _doc_factor(spark, sf_dir)
    row = [(m.block, m.n, round(m.kmo, 6), latent.kmo_label(m.kmo), round(m.bartlett_p, 6), m.n_factors,
            round(m.variance_pct, 2), len(m.cols))]
    return spark.createDataFrame(row, "block string, n long, kmo double, kmo_label string, bartlett_p double, "
                                      "n_factors int, variance_pct double, n_vars int")


_MCA_COLS = ["seg", "cat_program", "t1"]


def _burt_sql():
    parts = []
    for a in _MCA_COLS:
        for b in _MCA_COLS:
            parts.append(f"SELECT '{a}' AS var_a, {a} AS cat_a, '{b}' AS var_b, {b} AS cat_b, "
                         f"CAST(count(*) AS BIGINT) AS n FROM survey GROUP BY {a}, {b}")
    return "\nUNION ALL ".join(parts)


@register("mca_burt_counts", f"WITH {SURVEY_SQL}\n{_burt_sql()}")
def mca_burt_counts(spark, sf_dir):
    """M10 input: category-pair counts (Burt table) of three nominal answers."""
    return latent.burt_counts(survey(spark, sf_dir), _MCA_COLS)


@register("mca_coords")
def mca_coords(spark, sf_dir):
    """MCA row coordinates (3 dims) of mode-imputed nominal answers."""
    s = latent.mode_impute(survey(spark, sf_dir).select("row_id", *_MCA_COLS), _MCA_COLS)
    m = latent.fit_mca(s, _MCA_COLS, 3)
    return s.select("row_id", *m.coord_columns())


@register("mca_inertia")
def mca_inertia(spark, sf_dir):
    """Eigenvalues and inertia % of the first 3 MCA dimensions."""
    s = latent.mode_impute(survey(spark, sf_dir).select("row_id", *_MCA_COLS), _MCA_COLS)
    m = latent.fit_mca(s, _MCA_COLS, 3)
    rows = [(i + 1, float(m.eigenvalues[i]), float(m.inertia_pct[i])) for i in range(len(m.inertia_pct))]
    return spark.createDataFrame(rows, "dim int, eigenvalue double, inertia_pct double")


_QN_SQL = f"""WITH src AS (SELECT o_orderkey, o_totalprice AS price,
                          CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prio FROM orders),
long AS ({sql_long("src", ["price", "prio"], ["o_orderkey"])}),
cnt AS (SELECT var, count(*) AS n, least(count(*), 1000) AS m FROM long GROUP BY var),
probs AS (SELECT var, n, i AS j,
                 CASE WHEN m <= 1 THEN 0.0E0 WHEN i = m - 1 THEN 1.0E0 ELSE i * (1.0E0 / (m - 1)) END AS p
          FROM cnt, range(0, 1000) t(i) WHERE i < m),
ord AS (SELECT var, val, row_number() OVER (PARTITION BY var ORDER BY val) - 1 AS idx FROM long),
pos AS (SELECT var, j, p, (n - 1) * (p * 100.0E0 / 100.0E0) AS ps FROM probs),
pos2 AS (SELECT *, floor(ps) AS lo, ceil(ps) AS hi, ps - floor(ps) AS t FROM pos),
q AS (SELECT pos2.var, pos2.p,
             CASE WHEN t >= 0.5 THEN b.val - (b.val - a.val) * (1.0E0 - t) ELSE a.val + (b.val - a.val) * t END AS q
      FROM pos2 JOIN ord a ON a.var = pos2.var AND a.idx = pos2.lo JOIN ord b ON b.var = pos2.var AND b.idx = pos2.hi),
kn AS (SELECT var, q AS u, min(p) AS r_lo, max(p) AS r_hi FROM q GROUP BY var, q),
kn2 AS (SELECT *, lead(u) OVER (PARTITION BY var ORDER BY u) AS nu, lead(r_lo) OVER (PARTITION BY var ORDER BY u) AS nlo,
               min(u) OVER (PARTITION BY var) AS umin, max(u) OVER (PARTITION BY var) AS umax FROM kn),
vals AS (SELECT DISTINCT var, val FROM long),
mt AS (SELECT v.var, v.val, k.u, k.r_lo, k.r_hi, k.nu, k.nlo, k.umin, k.umax
       FROM vals v ASOF LEFT JOIN kn2 k ON v.var = k.var AND v.val >= k.u),
pr AS (SELECT var, val,
              CASE WHEN val - 1e-7 < (SELECT min(u) FROM kn2 WHERE kn2.var = mt.var) THEN 0.0E0
                   WHEN val + 1e-7 > (SELECT max(u) FROM kn2 WHERE kn2.var = mt.var) THEN 1.0E0
                   WHEN val = u THEN (r_lo + r_hi) / 2.0E0
                   ELSE r_hi + (val - u) * (nlo - r_hi) / (nu - u) END AS p0 FROM mt),
pc AS (SELECT var, val, least(greatest(p0, 1e-7), 1.0E0 - 1e-7) AS pp FROM pr),
z AS (SELECT var, val, {inv_normal_sql('pp')} AS z FROM pc)
SELECT s.o_orderkey, round(a.z, 6) AS price_qn, round(b.z, 6) AS prio_qn
FROM src s JOIN z a ON a.var = 'price' AND a.val = s.price JOIN z b ON b.var = 'prio' AND b.val = s.prio"""


@register("quantile_normal", _QN_SQL)
def quantile_normal(spark, sf_dir):
    """1000-point quantile grid → interpolate → inverse normal (clipped)."""
    o = load(spark, sf_dir, "orders")
    src = o.select("o_orderkey", F.col("o_totalprice").alias("price"),
                   F.substring("o_orderpriority", 1, 1).cast("double").alias("prio"))
    grid = ranks.quantile_grid(src, ["price", "prio"], 1000)
    t = ranks.quantile_normal_transform(src, grid, ["price", "prio"], suffix="_qn")
    return t.select("o_orderkey", r6("price_qn").alias("price_qn"), r6("prio_qn").alias("prio_qn"))


# two latent columns: quantile → normal as above, then components in closed form
_LATENT2_SQL = _QN_SQL[:_QN_SQL.rindex("SELECT s.o_orderkey")].rstrip() + """,
pts AS (SELECT s.o_orderkey AS row_id, a.z AS x0, b.z AS x1
        FROM src s JOIN z a ON a.var = 'price' AND a.val = s.price JOIN z b ON b.var = 'prio' AND b.val = s.prio),
cv AS (SELECT covar_samp(x0, x0) AS a, covar_samp(x0, x1) AS b, covar_samp(x1, x1) AS d, avg(x0) AS m0, avg(x1) AS m1 FROM pts),
ev AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS l1 FROM cv),
v AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS u0, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS u1 FROM ev),
sg AS (SELECT *, CASE WHEN (CASE WHEN abs(u0) >= abs(u1) THEN u0 ELSE u1 END) < 0 THEN -1 ELSE 1 END AS s FROM v),
c2 AS (SELECT *, s * u0 AS a0, s * u1 AS a1, -s * u1 AS b0, s * u0 AS b1 FROM sg),
c3 AS (SELECT *, CASE WHEN (CASE WHEN abs(b0) >= abs(b1) THEN b0 ELSE b1 END) < 0 THEN -1 ELSE 1 END AS t FROM c2)
SELECT row_id, round(a0 * (x0 - m0) + a1 * (x1 - m1), 5) AS pc1, round(t * (b0 * (x0 - m0) + b1 * (x1 - m1)), 5) AS pc2
FROM pts, c3"""


@register("latent_space_2d", _LATENT2_SQL)
def latent_space_2d(spark, sf_dir):
    """Quantile → normal and principal components of two columns (closed form)."""
    src = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").cast("double").alias("price"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("prio"))
    scores, _, _ = latent.latent_space(src, ["price", "prio"], "row_id", 2)
    return scores.select("row_id", F.round("pc1", 5).alias("pc1"), F.round("pc2", 5).alias("pc2"))


_PCA2_CTE = f"""{embed_points_sql(2)},
cv AS (SELECT covar_samp(x0, x0) AS a, covar_samp(x0, x1) AS b, covar_samp(x1, x1) AS d,
              avg(x0) AS m0, avg(x1) AS m1 FROM pts),
ev AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS l1,
                 (a + d) / 2 - sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS l2 FROM cv)"""


@register("pca_variance", f"""WITH {_PCA2_CTE}
SELECT 1 AS comp, round(l1, 6) AS eigenvalue, round(l1 / (a + d), 6) AS ratio FROM ev
UNION ALL SELECT 2, round(l2, 6), round(l2 / (a + d), 6) FROM ev""")
def pca_variance(spark, sf_dir):
    """Eigenvalues and explained-variance ratio (2-d case: closed-form oracle)."""
    p = embed_points(spark, sf_dir, 2)
    m = latent.fit_pca(p, ["x0", "x1"], 2)
    rows = [(k + 1, round(float(m.explained_variance[k]), 6), round(float(m.explained_ratio[k]), 6))
            for k in range(2)]
    return spark.createDataFrame(rows, "comp int, eigenvalue double, ratio double")


@register("pca_scores", f"""WITH {_PCA2_CTE},
v AS (SELECT *, b AS v0r, l1 - a AS v1r FROM ev),
nv AS (SELECT *, v0r / sqrt(v0r * v0r + v1r * v1r) AS u0, v1r / sqrt(v0r * v0r + v1r * v1r) AS u1 FROM v),
sg AS (SELECT *, CASE WHEN (CASE WHEN abs(u0) >= abs(u1) THEN u0 ELSE u1 END) < 0 THEN -1 ELSE 1 END AS s FROM nv)
SELECT row_id, round(s * (u0 * (x0 - m0) + u1 * (x1 - m1)), 6) AS pc1 FROM pts, sg""")
def pca_scores(spark, sf_dir):
    """Centred scores on the first component (2-d closed-form oracle)."""
    p = embed_points(spark, sf_dir, 2)
    m = latent.fit_pca(p, ["x0", "x1"], 1)
    return p.select("row_id", *[r6(c).alias("pc1") for c in m.score_columns()])


_DIMS = [f"x{i}" for i in range(EMBED_DIMS)]


@register("pca_full")
def pca_full(spark, sf_dir):
    """PCA of all 64 columns: variance table, cumulative %, Kaiser line, n for 85 %."""
    m = latent.fit_pca(embed_columns(spark, sf_dir), _DIMS)
    table = spark.createDataFrame([(k + 1, float(v * 100)) for k, v in enumerate(m.explained_ratio)],
                                  "comp int, pct double")
    cum, first = profile.cumulative_share(table, "comp", "pct", 85.0)
    n85 = first.first()["n_for_target"] or len(_DIMS)
    return cum.select("comp", "pct", F.col("cum").alias("cum_pct"), F.lit(100.0 / len(_DIMS)).alias("kaiser_pct"),
                      F.lit(int(n85)).alias("n_for_85"))


_COV64 = """c AS MATERIALIZED (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM l a JOIN l b ON a.row_id = b.row_id GROUP BY a.i, b.i)"""
_LONG64 = """l AS MATERIALIZED (SELECT vec_id AS row_id, t.i, CAST(embedding[t.i + 1] AS DOUBLE) AS x FROM embeddings, range(0, 64) t(i))"""


@register("pca_invariants", f"""WITH {_LONG64}, {_COV64}
SELECT (SELECT round(sum(c), 6) FROM c WHERE i = j) AS sum_1, (SELECT round(sum(c * c), 6) FROM c) AS sum_2,
       (SELECT round(sum(a.c * b.c * d.c), 6) FROM c a JOIN c b ON b.i = a.j JOIN c d ON d.i = b.j AND d.j = a.i) AS sum_3,
       CAST(64 AS BIGINT) AS n_comp""")
def pca_invariants(spark, sf_dir):
    """Power sums of the 64 eigenvalues (the traces of the covariance matrix's powers)."""
    w = latent.fit_pca(embed_columns(spark, sf_dir), _DIMS).explained_variance
    return spark.createDataFrame([tuple(round(float((w ** p).sum()), 6) for p in (1, 2, 3)) + (len(w),)],
                                 "sum_1 double, sum_2 double, sum_3 double, n_comp long")


@register("corr_wide", f"""WITH {_LONG64}
SELECT 'x' || a.i AS var1, 'x' || b.i AS var2, round(corr(a.x, b.x), 6) AS r
FROM l a JOIN l b ON a.row_id = b.row_id AND a.i < b.i GROUP BY a.i, b.i""")
def corr_wide(spark, sf_dir):
    """Correlations of all pairs of 64 columns, one aggregation."""
    return profile.corr_pairs(embed_columns(spark, sf_dir), _DIMS).select("var1", "var2", r6("r").alias("r"))


_MCA2 = ["dear", "urgent"]
_MCA2_SQL = """b AS (SELECT o_orderkey AS row_id, CAST(o_totalprice > 150000 AS INTEGER) AS u,
          CAST(substr(o_orderpriority, 1, 1) = '1' AS INTEGER) AS v FROM orders),
s AS (SELECT avg(u) AS p, avg(v) AS q, corr(u, v) AS phi FROM b),
-- standardised answers zu, zv: the dimensions are (zu ± zv) / 2 with eigenvalues (1 ± phi) / 2
d AS (SELECT *, CASE WHEN phi >= 0 THEN 1 ELSE -1 END AS g FROM s),
-- the largest entry among sqrt((1-p)/2), -sqrt(p/2), ±sqrt((1-q)/2), ∓sqrt(q/2) is positive
w AS (SELECT *, greatest(1 - p, p) >= greatest(1 - q, q) AS of_u, CASE WHEN 1 - p >= p THEN 1 ELSE -1 END AS su,
             CASE WHEN 1 - q >= q THEN 1 ELSE -1 END AS sv FROM d),
e AS (SELECT *, CASE WHEN of_u THEN su ELSE g * sv END AS s1, CASE WHEN of_u THEN su ELSE -g * sv END AS s2 FROM w)"""


@register("mca_two_answers", f"""WITH {_MCA2_SQL}
SELECT row_id, round(s1 * ((u - p) / sqrt(p * (1 - p)) + g * (v - q) / sqrt(q * (1 - q))) / 2, 6) AS acm_dim1,
       round(s2 * ((u - p) / sqrt(p * (1 - p)) - g * (v - q) / sqrt(q * (1 - q))) / 2, 6) AS acm_dim2,
       round((1 + abs(phi)) / 2, 6) AS eigenvalue_1, round((1 - abs(phi)) / 2, 6) AS eigenvalue_2,
       round(100 * (1 + abs(phi)) / 2, 2) AS inertia_pct_1
FROM b, e""")
def mca_two_answers(spark, sf_dir):
    """M10 on two yes/no answers: coordinates and inertia have a closed form."""
    o = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") > 150000).cast("string").alias("dear"),
        (F.substring("o_orderpriority", 1, 1) == "1").cast("string").alias("urgent"))
    m = latent.fit_mca(o, _MCA2, 2)
    a, b = m.coord_columns()
    return o.select("row_id", r6(a).alias("acm_dim1"), r6(b).alias("acm_dim2"),
                    F.lit(round(float(m.eigenvalues[0]), 6)).alias("eigenvalue_1"),
                    F.lit(round(float(m.eigenvalues[1]), 6)).alias("eigenvalue_2"),
                    F.lit(float(m.inertia_pct[0])).alias("inertia_pct_1"))


# two of three components: what the third leaves out, 1 - λ₃·u₃², is known in closed
# form and does not change under rotation
_COMMUNALITY_SQL = f"""WITH {_spearman_cte()},
ev AS (SELECT *, sqrt((a * a + b * b + c * c) / 3.0E0) AS pp FROM rr),
ev3 AS (SELECT *, 1.0E0 + 2 * pp * cos((acos(greatest(-1.0E0, least(1.0E0, a * b * c / (pp * pp * pp)))) + 2 * pi()) / 3.0E0)
                 AS lam FROM ev),
v AS (SELECT lam, a * c - b * (1 - lam) AS v1, b * a - (1 - lam) * c AS v2, (1 - lam) * (1 - lam) - a * a AS v3 FROM ev3),
nv AS (SELECT lam, v1 * v1 / s AS u1, v2 * v2 / s AS u2, v3 * v3 / s AS u3
       FROM (SELECT *, v1 * v1 + v2 * v2 + v3 * v3 AS s FROM v)),
t AS (SELECT 'n_chars' AS var, 1 - lam * u1 AS h, lam FROM nv UNION ALL SELECT 'n_words', 1 - lam * u2, lam FROM nv
      UNION ALL SELECT 'n_lines', 1 - lam * u3, lam FROM nv)
SELECT var, round(h, 6) AS communality, round((3 - lam) / 3 * 100, 6) AS variance_pct FROM t"""


@register("factor_communalities", _COMMUNALITY_SQL)
def factor_communalities(spark, sf_dir):
    """M8 with two oblimin-rotated factors: communalities and total variance, which no
    rotation changes."""
    d = doc_metrics(spark, sf_dir)
    rk = ranks.rank_columns(latent.median_impute(d, DOC_COLS), DOC_COLS, "row_id")
    m = latent.fit_factor_block(rk, DOC_COLS, 2, "docs")
    h = (m.loadings * m.structure).sum(1)
    rows = [(c, round(float(x), 6), round(float(h.sum() / len(DOC_COLS) * 100), 6)) for c, x in zip(DOC_COLS, h)]
    return spark.createDataFrame(rows, "var string, communality double, variance_pct double")


@register("latent_space")
def latent_space(spark, sf_dir):
    """Factor scores + MCA coordinates → quantile-normal → PCA(3) per respondent."""
    s = survey(spark, sf_dir)
    items = ["q1", "q2", "q3", "q4"]
    v = latent.median_impute(s.select("row_id", *items), items)
    rk = ranks.rank_columns(v, items, "row_id")
    fm = latent.fit_factor_block(rk, items, 2, "B")
    fs = rk.select("row_id", *fm.score_columns())
    nom = latent.mode_impute(s.select("row_id", *_MCA_COLS), _MCA_COLS)
    mca = latent.fit_mca(nom, _MCA_COLS, 3)
    mc = nom.select("row_id", *mca.coord_columns())
    lat = fs.join(mc, "row_id")
    cols = [c for c in lat.columns if c != "row_id"]
    scores, _, _ = latent.latent_space(lat, cols, "row_id", 3)
    return scores


_FS2 = ["n_chars", "n_words"]
_FS2_SQL = f"""WITH {DOC_METRICS_SQL},
rk AS (SELECT row_id,
              rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0E0 AS a,
              rank() OVER (ORDER BY n_words) + (count(*) OVER (PARTITION BY n_words) - 1) / 2.0E0 AS b FROM docm),
st AS (SELECT corr(a, b) AS r, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM rk)
SELECT row_id, round(sqrt((1 + r) / 2) / (1 + r) * ((a - ma) / sa + (b - mb) / sb), 6) AS docs2_F1
FROM rk, st"""


@register("factor_scores_2v", _FS2_SQL)
def factor_scores_2v(spark, sf_dir):
    """M8 on a two-item block: closed-form one-factor solution checked by SQL
    (loading √((1+r)/2), regression weights R⁻¹·loading = loading/(1+r))."""
    d = doc_metrics(spark, sf_dir)
    rk = ranks.rank_columns(latent.median_impute(d, _FS2), _FS2, "row_id")
    m = latent.fit_factor_block(rk, _FS2, 1, "docs2")
    return rk.select("row_id", *[r6(c).alias("docs2_F1") for c in m.score_columns()])


@register("pca_projection", f"""WITH {_PCA2_CTE},
v AS (SELECT *, b AS v0r, l1 - a AS v1r FROM ev),
nv AS (SELECT *, v0r / sqrt(v0r * v0r + v1r * v1r) AS u0, v1r / sqrt(v0r * v0r + v1r * v1r) AS u1 FROM v),
sg AS (SELECT *, CASE WHEN (CASE WHEN abs(u0) >= abs(u1) THEN u0 ELSE u1 END) < 0 THEN -1 ELSE 1 END AS s FROM nv),
c2 AS (SELECT *, s * u0 AS a0, s * u1 AS a1, -s * u1 AS b0, s * u0 AS b1 FROM sg),
c3 AS (SELECT *, CASE WHEN (CASE WHEN abs(b0) >= abs(b1) THEN b0 ELSE b1 END) < 0 THEN -1 ELSE 1 END AS t FROM c2),
sc AS (SELECT p.label, a0 * (x0 - m0) + a1 * (x1 - m1) AS pc1, t * (b0 * (x0 - m0) + b1 * (x1 - m1)) AS pc2
       FROM pts p, c3)
SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(pc1), 6) AS pc1, round(avg(pc2), 6) AS pc2
FROM sc GROUP BY label""")
def pca_projection(spark, sf_dir):
    """2-D principal projection and the centroid of every segment in it."""
    from tessera.operators import validate
    p = embed_points(spark, sf_dir, 2)
    m = latent.fit_pca(p, ["x0", "x1"], 2)
    proj = p.select("label", *m.score_columns())
    c = validate.centroids(proj, ["pc1", "pc2"], "label")
    return c.select("label", F.col("n").cast("long").alias("n"), r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))
