"""Segmentation queries (M16–M19) on the embedding points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import latent, segment, validate
from tessera.plans import flows, q_latent
from tessera.plans.catalog import register
from tessera.plans.proxies import SURVEY_SQL, embed_points, embed_points_sql, survey
from tessera.sources.scratch import saved

_X = ["x0", "x1", "x2"]
_PTS = embed_points_sql(3)
_D = "sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))"


@register("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    """K-means for k = 2..7 (30 starts each): inertia, convergence, balance, metrics."""
    p = embed_points(spark, sf_dir, 3)
    labels, inertia, _ = segment.kmeans_sweep(p, _X, range(2, 8))
    met = validate.metrics_table(p.select("row_id", *_X), _X, labels, "row_id", ("k",))
    cost = spark.createDataFrame([(int(k), float(c), bool(done)) for k, c, done in inertia],
                                 "k int, inertia double, converged boolean")
    return (met.withColumn("k", F.col("k").cast("int")).join(cost, "k")
            .select(F.lit("kmeans").alias("method"), "k", "inertia", "converged", "sil", "db", "dunn", "n_dunn", "cv",
                    "min_pct", "score"))


@register("kmeans_labels")
def kmeans_labels(spark, sf_dir):
    """Cluster of every point for every k (long table)."""
    return segment.kmeans_sweep(embed_points(spark, sf_dir, 3), _X, range(2, 8))[0]


_STARTS, _ROUNDS = 5, 300


def _kmeans_sql() -> str:
    """Lloyd's rounds as a recursive query: its rows are the centres of all starts."""
    near = """SELECT c.k, c.i, p.row_id, p.x0, p.x1, p.x2,
        min(((p.x0 - c.x0) * (p.x0 - c.x0) + (p.x1 - c.x1) * (p.x1 - c.x1) + (p.x2 - c.x2) * (p.x2 - c.x2), c.j)) AS best
      FROM {centres} c JOIN pts p ON true GROUP BY ALL"""
    return f"""WITH RECURSIVE {_PTS},
o AS (SELECT x0, x1, x2, row_number() OVER (ORDER BY md5(concat('42', CAST(row_id AS VARCHAR))), row_id) - 1 AS r FROM pts),
c0 AS (SELECT k, r // k AS i, r % k AS j, x0, x1, x2 FROM o JOIN range(2, 8) t(k) ON r < {_STARTS} * k),
lim AS (SELECT 1e-4 * (var_pop(x0) + var_pop(x1) + var_pop(x2)) / 3 AS lim FROM pts),
st AS (
  SELECT 0 AS round, k, i, j, x0, x1, x2, false AS done FROM c0
  UNION ALL
  SELECT * FROM (
    WITH near AS ({near.format(centres="(SELECT * FROM st WHERE NOT done)")}),
    m AS (SELECT k, i, best[2] AS j, avg(x0) AS x0, avg(x1) AS x1, avg(x2) AS x2 FROM near GROUP BY ALL),
    n AS (SELECT st.round + 1 AS round, st.k, st.i, st.j, coalesce(m.x0, st.x0) AS x0, coalesce(m.x1, st.x1) AS x1,
                 coalesce(m.x2, st.x2) AS x2, st.done,
                 (coalesce(m.x0, st.x0) - st.x0) ** 2 + (coalesce(m.x1, st.x1) - st.x1) ** 2
                   + (coalesce(m.x2, st.x2) - st.x2) ** 2 AS moved
          FROM st LEFT JOIN m ON m.k = st.k AND m.i = st.i AND m.j = st.j)
    SELECT round, k, i, j, x0, x1, x2, done OR sum(moved) OVER (PARTITION BY k, i) <= (SELECT lim FROM lim) FROM n
    WHERE round <= {_ROUNDS} AND (SELECT count(*) FROM st WHERE NOT done) > 0)),
last AS (SELECT * FROM st WHERE round = (SELECT max(round) FROM st)),
cost AS (SELECT k, i, sum(best[1]) AS cost FROM ({near.format(centres="last")}) GROUP BY k, i)
SELECT k, round(min(cost), 6) AS inertia, (SELECT bool_and(done) FROM last l WHERE l.k = cost.k) AS converged FROM cost GROUP BY k"""


@register("kmeans_fixed_starts", _kmeans_sql())
def kmeans_fixed_starts(spark, sf_dir):
    """Best of five stated starts per k (seeded rows), Lloyd's rounds to convergence."""
    p = saved(embed_points(spark, sf_dir, 3), "points")
    first = [[r[x] for x in _X] for r in validate.md5_sample(p, "row_id", _STARTS * 7).collect()]
    starts = {(k, i): np.array(first[i * k:(i + 1) * k]) for k in range(2, 8) for i in range(_STARTS)}
    fitted = segment.kmeans_fit(p, _X, range(2, 8), starts=starts, max_iter=_ROUNDS)
    rows = [(k, round(c, 6), bool(done)) for k, (_, c, done) in fitted.items()]
    return spark.createDataFrame(rows, "k long, inertia double, converged boolean")


#: Ward's agglomeration as a recursive query: its rows are the clusters of a step.
_WARD_SQL = f"""WITH RECURSIVE {_PTS},
leaf AS (SELECT row_number() OVER (ORDER BY x0, x1, x2) - 1 AS id, CAST(count(*) AS DOUBLE) AS w, x0, x1, x2,
                count(*) OVER () AS m FROM pts GROUP BY x0, x1, x2),
st AS (
  SELECT 0 AS step, id, w, x0, x1, x2, m, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS cost FROM leaf
  UNION ALL
  SELECT * FROM (
    WITH best AS (
      SELECT p.id AS a, q.id AS b, p.w * q.w / (p.w + q.w) * ((p.x0 - q.x0) * (p.x0 - q.x0)
               + (p.x1 - q.x1) * (p.x1 - q.x1) + (p.x2 - q.x2) * (p.x2 - q.x2)) AS cost
      FROM st p JOIN st q ON p.id < q.id ORDER BY cost LIMIT 1),
    k AS (SELECT st.*, best.a AS ba, best.b AS bb, best.cost AS bc,
                 CASE WHEN st.id IN (best.a, best.b) THEN -1 ELSE st.id END AS k FROM st, best)
    SELECT max(step) + 1, CASE WHEN k = -1 THEN max(m) + max(step) ELSE k END, sum(w), sum(w * x0) / sum(w),
           sum(w * x1) / sum(w), sum(w * x2) / sum(w), max(m), max(ba), max(bb), max(bc) FROM k GROUP BY k))"""


@register("ward_micro", f"""{_WARD_SQL},
cut AS (SELECT m - step AS k, w, m FROM st WHERE m - step BETWEEN 2 AND 7)
SELECT CAST(k AS INTEGER) AS k, count(*) AS n_clusters, round(stddev_samp(w) / avg(w), 4) AS cv,
       round(min(w) / sum(w) * 100.0E0, 2) AS min_pct, round(max(w) / sum(w) * 100.0E0, 2) AS max_pct,
       CAST(max(m) AS INTEGER) AS n_micro FROM cut GROUP BY k""")
def ward_micro(spark, sf_dir):
    """Ward sweep: balance per k and the leaves used (every distinct point, up to 4,096)."""
    labels, _, used = segment.ward_micro(embed_points(spark, sf_dir, 3), _X, range(2, 8))
    return validate.balance(labels, "cluster", ["k"]).withColumn("n_micro", F.lit(used))


@register("ward_merges", f"""{_WARD_SQL}
SELECT step, max(a) AS a, max(b) AS b, round(sqrt(2 * max(cost)), 6) AS height,
       max(CASE WHEN id = m + step - 1 THEN w END) AS size FROM st WHERE step > 0 GROUP BY step""")
def ward_merges(spark, sf_dir):
    """The merge table (step, a, b, height, size) — dendrogram data."""
    merges = segment.ward_micro(embed_points(spark, sf_dir, 3), _X, range(2, 3))[1]
    return merges.withColumn("height", F.round("height", 6))


_EPS, _MINPTS = 0.3, 5


@register("dbscan_core_flags", f"""WITH {_PTS},
n AS (SELECT a.row_id, count(*) AS nn FROM pts a JOIN pts b ON {_D} <= {_EPS} GROUP BY a.row_id)
SELECT row_id, nn >= {_MINPTS} AS is_core FROM n""")
def dbscan_core_flags(spark, sf_dir):
    """Core points (≥ 5 neighbours within ε, self included)."""
    p = embed_points(spark, sf_dir, 3)
    c = segment.eps_neighbor_counts(p, _X, _EPS, "row_id")
    return c.select("row_id", (F.col("n_neighbors") >= _MINPTS).alias("is_core"))


_DBSCAN_SQL = f"""WITH RECURSIVE {_PTS},
nb AS (SELECT a.row_id AS a, b.row_id AS b FROM pts a JOIN pts b ON {_D} <= {_EPS}),
core AS (SELECT a AS row_id FROM nb GROUP BY a HAVING count(*) >= {_MINPTS}),
ce AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.row_id JOIN core c2 ON nb.b = c2.row_id),
reach(src, dst) AS (SELECT row_id, row_id FROM core
                    UNION SELECT r.src, ce.b FROM reach r JOIN ce ON r.dst = ce.a),
comp AS (SELECT dst AS row_id, min(src) AS lab FROM reach GROUP BY dst),
border AS (SELECT nb.a AS row_id, min(comp.lab) AS lab FROM nb JOIN comp ON nb.b = comp.row_id
           WHERE nb.a NOT IN (SELECT row_id FROM core) GROUP BY nb.a),
labeled AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
names AS (SELECT lab, dense_rank() OVER (ORDER BY lab) - 1 AS cluster FROM (SELECT DISTINCT lab FROM comp))
SELECT p.row_id, CAST(coalesce(n.cluster, -1) AS BIGINT) AS cluster
FROM pts p LEFT JOIN labeled l ON p.row_id = l.row_id LEFT JOIN names n ON l.lab = n.lab"""


@register("dbscan_labels", _DBSCAN_SQL)
def dbscan_labels(spark, sf_dir):
    """DBSCAN labels (noise −1) for ε = 0.3, minPts = 5."""
    p = embed_points(spark, sf_dir, 3)
    return segment.dbscan(p, _X, _EPS, _MINPTS, "row_id")


_GRID = [(e, m) for e in (0.12, 0.15, 0.18, 0.21, 0.24, 0.3) for m in (3, 5, 8)]
_D2 = "((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))"

_GRID_SQL = f"""WITH RECURSIVE {_PTS},
st AS (SELECT * FROM (VALUES {', '.join(f'({e}E0, {m})' for e, m in _GRID)}) t(eps, mp)),
pr AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b, {_D} AS d, {_D2} AS d2 FROM pts a JOIN pts b ON true),
nb AS (SELECT eps, mp, a, b FROM pr JOIN st ON d <= eps),
core AS (SELECT eps, mp, a AS row_id FROM nb GROUP BY eps, mp, a HAVING count(*) >= mp),
ce AS (SELECT nb.* FROM nb JOIN core c1 ON c1.eps = nb.eps AND c1.mp = nb.mp AND nb.a = c1.row_id
       JOIN core c2 ON c2.eps = nb.eps AND c2.mp = nb.mp AND nb.b = c2.row_id),
reach(eps, mp, src, dst) AS (SELECT eps, mp, row_id, row_id FROM core
  UNION SELECT r.eps, r.mp, r.src, ce.b FROM reach r JOIN ce ON ce.eps = r.eps AND ce.mp = r.mp AND r.dst = ce.a),
comp AS (SELECT eps, mp, dst AS row_id, min(src) AS lab FROM reach GROUP BY ALL),
border AS (SELECT nb.eps, nb.mp, nb.a AS row_id, min(comp.lab) AS lab
           FROM nb JOIN comp ON comp.eps = nb.eps AND comp.mp = nb.mp AND nb.b = comp.row_id
           LEFT JOIN core ON core.eps = nb.eps AND core.mp = nb.mp AND core.row_id = nb.a
           WHERE core.row_id IS NULL GROUP BY ALL),
l AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
stat AS (SELECT st.eps, st.mp, count(DISTINCT lab) AS k, 100.0E0 * (count(*) - count(lab)) / count(*) AS noise
         FROM st JOIN pts ON true LEFT JOIN l ON l.eps = st.eps AND l.mp = st.mp AND l.row_id = pts.row_id GROUP BY ALL),
md AS (SELECT x.eps, x.mp, x.row_id, x.lab = y.lab AS own, y.lab AS lb, avg(d2) AS m
       FROM l x JOIN l y ON x.eps = y.eps AND x.mp = y.mp AND x.row_id <> y.row_id
       JOIN pr ON pr.a = x.row_id AND pr.b = y.row_id GROUP BY ALL),
ab AS (SELECT eps, mp, row_id, max(CASE WHEN own THEN m END) AS a, min(CASE WHEN NOT own THEN m END) AS b FROM md GROUP BY ALL),
sil AS (SELECT eps, mp, avg(CASE WHEN a IS NULL THEN 0.0E0 ELSE (b - a) / greatest(a, b) END) AS sil FROM ab GROUP BY ALL),
sz AS (SELECT eps, mp, lab, count(*) AS n FROM l GROUP BY ALL),
bal AS (SELECT eps, mp, round(min(n) / sum(n) * 100.0E0, 2) AS min_pct FROM sz GROUP BY ALL)
SELECT stat.eps, CAST(stat.mp AS INTEGER) AS min_pts, CAST(k AS BIGINT) AS n_clusters, round(noise, 1) AS noise_pct,
       k >= 2 AND noise < 20 AS viable, CASE WHEN k >= 2 AND noise < 20 THEN round(sil, 4) END AS sil,
       CASE WHEN k >= 2 AND noise < 20 THEN min_pct END AS min_pct
FROM stat LEFT JOIN sil USING (eps, mp) LEFT JOIN bal USING (eps, mp)"""


@register("dbscan_grid", _GRID_SQL)
def dbscan_grid(spark, sf_dir):
    """M19 sweep, 6 ε × 3 minPts at once: clusters, noise; metrics of the viable (≥ 2 clusters, < 20 % noise)."""
    return flows.dbscan_summary(embed_points(spark, sf_dir, 3), _X, _GRID, "row_id")


@register("kprototypes")
def kprototypes(spark, sf_dir):
    """K-prototypes for k = 2..7 on survey items (median-imputed) and nominal answers (gaps 'Otro');
    the metrics are those of the labels on the latent table."""
    s = survey(spark, sf_dir)
    num, cat = ["q1", "q2", "q4"], ["cat_program", "t1"]
    v = latent.median_impute(s.select("row_id", *num, *cat), num)
    v = v.withColumns({c: F.coalesce(F.col(c), F.lit("Otro")) for c in cat})
    labels, costs = segment.kprototypes_sweep(v, num, cat, range(2, 8), "row_id")
    space = saved(q_latent.latent_space(spark, sf_dir), "space")
    met = validate.metrics_table(space, [c for c in space.columns if c != "row_id"], labels, "row_id", ("k",))
    cost = spark.createDataFrame([(int(k), float(c), bool(done)) for k, c, done in costs],
                                 "k int, cost double, converged boolean")
    return met.withColumn("k", F.col("k").cast("int")).join(cost, "k").select(
        "k", "cost", "converged", "sil", "db", "dunn", "n_dunn", "cv", "min_pct", "max_pct", "score")


_KP_NUM, _KP_CAT = ["q1", "q2", "q4"], ["cat_program", "t1"]


def _kprototypes_sql() -> str:
    """Rounds of k-prototypes as a recursive query over the prototypes of every k."""
    cost = """(v.q1 - c.q1) * (v.q1 - c.q1) + (v.q2 - c.q2) * (v.q2 - c.q2) + (v.q4 - c.q4) * (v.q4 - c.q4)
        + v.g * (CAST(v.cat_program <> c.cat_program AS DOUBLE) + CAST(v.t1 <> c.t1 AS DOUBLE))"""
    med = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM survey)) AS {c}" for c in _KP_NUM)
    return f"""WITH RECURSIVE {SURVEY_SQL},
u AS MATERIALIZED (SELECT row_id, {med}, coalesce(cat_program, 'Otro') AS cat_program, coalesce(t1, 'Otro') AS t1 FROM survey),
v AS MATERIALIZED (SELECT u.*, g FROM u, (SELECT 0.5E0 * (stddev_samp(q1) + stddev_samp(q2) + stddev_samp(q4)) / 3 AS g FROM u)),
o AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42', CAST(row_id AS VARCHAR))), row_id) - 1 AS j FROM v),
st AS (
  SELECT 0 AS round, k, j, q1, q2, q4, cat_program, t1, CAST(NULL AS DOUBLE) AS tot, false AS done
  FROM o JOIN range(2, 5) t(k) ON j < k
  UNION ALL
  SELECT * FROM (
    WITH c AS (SELECT * FROM st WHERE NOT done),
    a AS (SELECT c.k, v.row_id, min(({cost}, c.j)) AS best FROM c JOIN v ON true GROUP BY ALL),
    s AS (SELECT k, sum(best[1]) AS tot FROM a GROUP BY k),
    m AS (SELECT a.k, a.best[2] AS j, avg(q1) AS q1, avg(q2) AS q2, avg(q4) AS q4 FROM a JOIN v USING (row_id) GROUP BY ALL),
    f AS (SELECT a.k, a.best[2] AS j, cat_program, count(*) AS n FROM a JOIN v USING (row_id) GROUP BY ALL),
    g AS (SELECT a.k, a.best[2] AS j, t1, count(*) AS n FROM a JOIN v USING (row_id) GROUP BY ALL),
    fm AS (SELECT k, j, arg_min(cat_program, (-n, cat_program)) AS cat_program FROM f GROUP BY ALL),
    gm AS (SELECT k, j, arg_min(t1, (-n, t1)) AS t1 FROM g GROUP BY ALL),
    w AS (SELECT DISTINCT k, round, tot AS was FROM c)
    SELECT w.round + 1, m.k, m.j, m.q1, m.q2, m.q4, fm.cat_program, gm.t1, s.tot,
           coalesce(w.was - s.tot <= 1e-9 * greatest(1.0, abs(s.tot)), false)
    FROM m JOIN fm USING (k, j) JOIN gm USING (k, j) JOIN s USING (k) JOIN w USING (k)))
SELECT CAST(k AS INTEGER) AS k, round(max(tot) FILTER (done), 4) AS cost, bool_or(done) AS converged FROM st GROUP BY k"""


@register("kprototypes_fixed_starts", _kprototypes_sql())
def kprototypes_fixed_starts(spark, sf_dir):
    """One stated start per k (seeded rows), rounds until the cost no longer falls."""
    v = latent.median_impute(survey(spark, sf_dir).select("row_id", *_KP_NUM, *_KP_CAT), _KP_NUM)
    v = saved(v.withColumns({c: F.coalesce(F.col(c), F.lit("Otro")) for c in _KP_CAT}), "answers")
    first = []
    for j, r in enumerate(validate.md5_sample(v, "row_id", 4).collect()):
        first.append({**{c: r[c] for c in [*_KP_NUM, *_KP_CAT]}, "cluster": j})
    _, costs = segment.kprototypes_sweep(v, _KP_NUM, _KP_CAT, range(2, 5), "row_id",
                                         starts={(k, 0): first[:k] for k in range(2, 5)})
    return spark.createDataFrame([(int(k), round(c, 4), bool(done)) for k, c, done in costs],
                                 "k int, cost double, converged boolean")


_EPS_FINE = 0.15


@register("dbscan_labels_fine", _DBSCAN_SQL.replace(f"<= {_EPS}", f"<= {_EPS_FINE}"))
def dbscan_labels_fine(spark, sf_dir):
    """DBSCAN at ε = 0.15, minPts = 5 — several clusters, borders and noise."""
    p = embed_points(spark, sf_dir, 3)
    return segment.dbscan(p, _X, _EPS_FINE, _MINPTS, "row_id")
