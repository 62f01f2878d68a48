"""Validation-metric queries on given labelings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.stats import ari_strength_sql
from tessera.operators import segment, validate
from tessera.plans.catalog import register, r6
from tessera.plans.proxies import embed_points, embed_points_sql
from tessera.sources.tables import load

_X = ["x0", "x1", "x2"]
_PTS = embed_points_sql(3)
_D = "sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))"


def _one(spark, **vals):
    cols = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint'}" for k, v in vals.items())
    return spark.createDataFrame([tuple(vals.values())], cols)


_SIL_SQL = f"""WITH {_PTS},
pair AS (SELECT a.row_id, a.label AS la, b.label AS lb, {_D} AS d FROM pts a JOIN pts b ON a.row_id <> b.row_id),
m AS (SELECT row_id, la, lb, avg(d) AS md FROM pair GROUP BY row_id, la, lb),
ab AS (SELECT row_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
       FROM m GROUP BY row_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0.0E0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n_anchors FROM ab"""


@register("silhouette", _SIL_SQL)
def silhouette(spark, sf_dir):
    """Mean Euclidean silhouette of the embedding labels over all rows."""
    s, n = validate.silhouette(embed_points(spark, sf_dir, 3), _X, "label")
    return _one(spark, silhouette=round(s, 6), n_anchors=n)


_SIL_SAMPLE_SQL = f"""WITH {_PTS},
anchor AS (SELECT * FROM pts ORDER BY md5(concat('42', CAST(row_id AS VARCHAR))), row_id LIMIT 200),
pair AS (SELECT a.row_id, a.label AS la, b.label AS lb, {_D} AS d FROM anchor a JOIN pts b ON a.row_id <> b.row_id),
m AS (SELECT row_id, la, lb, avg(d) AS md FROM pair GROUP BY row_id, la, lb),
ab AS (SELECT row_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
       FROM m GROUP BY row_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0.0E0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
       count(*) AS n_anchors FROM ab"""


@register("silhouette_sample", _SIL_SAMPLE_SQL)
def silhouette_sample(spark, sf_dir):
    """Euclidean silhouette over 200 seeded anchors, fewer than the rows."""
    s, n = validate.silhouette_sample(embed_points(spark, sf_dir, 3), _X, "label", "row_id", n_anchors=200)
    return _one(spark, silhouette=round(s, 6), n_anchors=n)


_SIL_ALL_SQL = f"""WITH {_PTS},
pair AS (SELECT a.row_id, a.label AS la, b.label AS lb, {_D} * {_D} AS d FROM pts a JOIN pts b ON a.row_id <> b.row_id),
m AS (SELECT row_id, la, lb, avg(d) AS md FROM pair GROUP BY row_id, la, lb),
ab AS (SELECT row_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
       FROM m GROUP BY row_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0.0E0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab"""


@register("silhouette_all", _SIL_ALL_SQL)
def silhouette_all(spark, sf_dir):
    """Silhouette of all rows on squared distances, from cluster moments."""
    return validate.silhouette_all(embed_points(spark, sf_dir, 3), _X, [], "label").select(
        r6("sil").alias("silhouette"))


_DB_SQL = f"""WITH {_PTS},
c AS (SELECT label, avg(x0) AS x0, avg(x1) AS x1, avg(x2) AS x2 FROM pts GROUP BY label),
s AS (SELECT a.label, avg({_D}) AS s FROM pts a JOIN c b ON a.label = b.label GROUP BY a.label),
cc AS (SELECT a.label AS i, b.label AS j, {_D} AS d FROM c a JOIN c b ON a.label <> b.label),
r AS (SELECT cc.i, max((si.s + sj.s) / cc.d) AS r FROM cc JOIN s si ON si.label = cc.i JOIN s sj ON sj.label = cc.j
      GROUP BY cc.i)
SELECT round(avg(r), 6) AS davies_bouldin FROM r"""


@register("davies_bouldin", _DB_SQL)
def davies_bouldin(spark, sf_dir):
    """Davies–Bouldin index of the embedding labels."""
    p = embed_points(spark, sf_dir, 3)
    return _one(spark, davies_bouldin=round(validate.davies_bouldin(p, _X, "label"), 6))


_DUNN_SQL = f"""WITH {_PTS},
smp AS (SELECT * FROM pts ORDER BY md5(concat('42', CAST(row_id AS VARCHAR))), row_id LIMIT 300),
pair AS (SELECT a.label AS la, b.label AS lb, {_D} AS d FROM smp a JOIN smp b ON a.row_id < b.row_id)
SELECT round(min(d) FILTER (WHERE la <> lb) / max(d) FILTER (WHERE la = lb), 6) AS dunn,
       (SELECT count(*) FROM smp) AS n_sample FROM pair"""


@register("dunn", _DUNN_SQL)
def dunn(spark, sf_dir):
    """Dunn index over a seeded md5 sample of 300 points, fewer than the rows."""
    d, n = validate.dunn(embed_points(spark, sf_dir, 3), _X, "label", "row_id", 300)
    return _one(spark, dunn=round(d, 6), n_sample=n)


@register("balance", f"""WITH {_PTS}, s AS (SELECT label, count(*) AS sz FROM pts GROUP BY label)
SELECT CAST(count(*) AS BIGINT) AS n_clusters, round(stddev_samp(sz) / avg(sz), 4) AS cv,
       round(min(sz) / sum(sz) * 100.0E0, 2) AS min_pct, round(max(sz) / sum(sz) * 100.0E0, 2) AS max_pct FROM s""")
def balance(spark, sf_dir):
    """A16, M20d: cv, min % and max % of the label sizes."""
    b = validate.balance(embed_points(spark, sf_dir, 3), "label")
    return b.select("n_clusters", "cv", "min_pct", "max_pct")


@register("md5_sample", f"""WITH {_PTS}
SELECT row_id, label FROM pts ORDER BY md5(concat('42', CAST(row_id AS VARCHAR))), row_id LIMIT 100""")
def md5_sample(spark, sf_dir):
    """Seeded sample without replacement (100 rows; sampling is the feature)."""
    return validate.md5_sample(embed_points(spark, sf_dir, 3).select("row_id", "label"), "row_id", 100)


@register("ari", """WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b FROM orders),
c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS nij FROM o GROUP BY a, b),
t AS (SELECT sum(nij * (nij - 1) / 2) AS sij, sum(nij) AS n FROM c),
ra AS (SELECT sum(ai * (ai - 1) / 2) AS sa FROM (SELECT a, sum(nij) AS ai FROM c GROUP BY a)),
cb AS (SELECT sum(bj * (bj - 1) / 2) AS sb FROM (SELECT b, sum(nij) AS bj FROM c GROUP BY b))
SELECT CAST(n AS BIGINT) AS n,
       round(CASE WHEN 0.5 * (sa + sb) = sa * sb / (n * (n - 1) / 2) THEN 1.0E0
             ELSE (sij - sa * sb / (n * (n - 1) / 2)) / (0.5 * (sa + sb) - sa * sb / (n * (n - 1) / 2)) END, 6) AS ari,
       CASE WHEN ari > 0.6 THEN 'alta' WHEN ari > 0.3 THEN 'moderada' ELSE 'baja' END AS strength
FROM t, ra, cb""")
def ari(spark, sf_dir):
    """Adjusted Rand index between order status and priority."""
    o = load(spark, sf_dir, "orders")
    a = validate.adjusted_rand(o, "o_orderstatus", "o_orderpriority")
    return a.select("n", r6("ari").alias("ari"), F.expr(ari_strength_sql("ari")).alias("strength"))


@register("ari_labels", f"""WITH {_PTS},
o AS (SELECT label AS a, row_id % 10 AS b FROM pts),
c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS nij FROM o GROUP BY a, b),
t AS (SELECT sum(nij * (nij - 1) / 2) AS sij, sum(nij) AS n FROM c),
ra AS (SELECT sum(ai * (ai - 1) / 2) AS sa FROM (SELECT a, sum(nij) AS ai FROM c GROUP BY a)),
cb AS (SELECT sum(bj * (bj - 1) / 2) AS sb FROM (SELECT b, sum(nij) AS bj FROM c GROUP BY b))
SELECT CAST(n AS BIGINT) AS n,
       round((sij - sa * sb / (n * (n - 1) / 2)) / (0.5 * (sa + sb) - sa * sb / (n * (n - 1) / 2)), 6) AS ari
FROM t, ra, cb""")
def ari_labels(spark, sf_dir):
    """ARI between the embedding label and id mod 10 (near 0)."""
    p = embed_points(spark, sf_dir, 3).withColumn("b", F.col("row_id") % 10)
    return validate.adjusted_rand(p, "label", "b").select("n", r6("ari").alias("ari"))


# --- labelings for the selection queries: two families over k = 2..5 -------
_KS = [2, 3, 4, 5]


def _labelings(spark, sf_dir):
    p = embed_points(spark, sf_dir, 3)
    out = []
    for k in _KS:
        out.append(("label_mod", k, p.withColumn("cluster", F.col("label") % k)))
        out.append(("id_mod", k, p.withColumn("cluster", F.col("row_id") % k)))
    return out


def _metrics_df(spark, sf_dir):
    p = embed_points(spark, sf_dir, 3)
    labels = None
    for method, k, df in _labelings(spark, sf_dir):
        part = df.select(F.lit(method).alias("method"), F.lit(k).alias("k"), "row_id", "cluster")
        labels = part if labels is None else labels.unionByName(part)
    m = validate.metrics_table(p.select("row_id", *_X), _X, labels, "row_id", ("method", "k"))
    return m.select("method", F.col("k").cast("int").alias("k"), "sil", "db", "dunn", "n_dunn", "cv", "min_pct", "score")


_LABS_SQL = f"""{_PTS},
ks AS (SELECT * FROM (VALUES (2), (3), (4), (5)) t(k)),
labs AS (SELECT 'label_mod' AS method, k, row_id, label % k AS cluster, x0, x1, x2 FROM pts, ks
         UNION ALL SELECT 'id_mod', k, row_id, row_id % k, x0, x1, x2 FROM pts, ks),
pair AS (SELECT a.method, a.k, a.row_id, a.cluster AS la, b.cluster AS lb, {_D} * {_D} AS d
         FROM labs a JOIN labs b ON a.method = b.method AND a.k = b.k AND a.row_id <> b.row_id),
sm AS (SELECT method, k, row_id, la, lb, avg(d) AS md FROM pair GROUP BY ALL),
ab AS (SELECT method, k, row_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
       FROM sm GROUP BY ALL),
sil AS (SELECT method, k, avg(CASE WHEN a IS NULL THEN 0.0E0 ELSE (b - a) / greatest(a, b) END) AS sil
        FROM ab GROUP BY ALL),
cen AS (SELECT method, k, cluster, avg(x0) AS x0, avg(x1) AS x1, avg(x2) AS x2 FROM labs GROUP BY ALL),
si AS (SELECT a.method, a.k, a.cluster, avg({_D}) AS s FROM labs a JOIN cen b
       ON a.method = b.method AND a.k = b.k AND a.cluster = b.cluster GROUP BY ALL),
cc AS (SELECT a.method, a.k, a.cluster AS i, b.cluster AS j, {_D} AS d FROM cen a JOIN cen b
       ON a.method = b.method AND a.k = b.k AND a.cluster <> b.cluster),
rr AS (SELECT cc.method, cc.k, cc.i, max((x.s + y.s) / cc.d) AS r FROM cc
       JOIN si x ON x.method = cc.method AND x.k = cc.k AND x.cluster = cc.i
       JOIN si y ON y.method = cc.method AND y.k = cc.k AND y.cluster = cc.j GROUP BY ALL),
db AS (SELECT method, k, avg(r) AS db FROM rr GROUP BY ALL),
smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, k
                         ORDER BY md5(concat('42', CAST(row_id AS VARCHAR))), row_id) AS rn FROM labs) WHERE rn <= 1000),
dp AS (SELECT a.method, a.k, a.cluster AS la, b.cluster AS lb, {_D} AS d FROM smp a JOIN smp b
       ON a.method = b.method AND a.k = b.k AND a.row_id < b.row_id),
du AS (SELECT method, k, coalesce(min(d) FILTER (WHERE la <> lb) / nullif(max(d) FILTER (WHERE la = lb), 0), 0) AS dunn
       FROM dp GROUP BY ALL),
dn AS (SELECT method, k, count(*) AS n_dunn FROM smp GROUP BY ALL),
sz AS (SELECT method, k, cluster, count(*) AS sz FROM labs GROUP BY ALL),
bal AS (SELECT method, k, round(stddev_samp(sz) / avg(sz), 4) AS cv, round(min(sz) / sum(sz) * 100.0E0, 2) AS min_pct
        FROM sz GROUP BY ALL),
met AS (SELECT sil.method, CAST(sil.k AS INTEGER) AS k, round(sil, 4) AS sil, round(db, 4) AS db,
               round(dunn, 4) AS dunn, n_dunn, cv, min_pct,
               round(0.35 * sil + 0.25 * dunn + 0.25 / (1 + db) + 0.15 / (1 + cv), 4) AS score
        FROM sil JOIN db USING (method, k) JOIN du USING (method, k) JOIN dn USING (method, k) JOIN bal USING (method, k))"""


@register("composite_score", f"WITH {_LABS_SQL}\nSELECT * FROM met")
def composite_score(spark, sf_dir):
    """M20e, M22 table: sil, DB, Dunn, balance and composite score per labeling."""
    return _metrics_df(spark, sf_dir)


_SELECT_SQL = f"""WITH {_LABS_SQL},
t AS (SELECT *, CASE WHEN k >= 3 AND min_pct >= 15 THEN 0 WHEN k >= 3 AND min_pct >= 10 THEN 1
                     WHEN k >= 3 THEN 2 ELSE 3 END AS tier FROM met),
c AS (SELECT method, k AS k_opt FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY tier, score DESC, k) AS r
                                      FROM t) WHERE r = 1),
s AS (SELECT method, k AS k_second FROM (
        SELECT t.*, row_number() OVER (PARTITION BY t.method ORDER BY score DESC, k) AS r
        FROM t JOIN c ON t.method = c.method WHERE t.k <> c.k_opt) WHERE r = 1)"""


@register("select_k", f"""{_SELECT_SQL}
SELECT c.method, c.k_opt, coalesce(s.k_second, c.k_opt) AS k_second FROM c LEFT JOIN s ON c.method = s.method""")
def select_k(spark, sf_dir):
    """Chosen k (tiered balance rule) and second-best k per method."""
    return validate.select_k(_metrics_df(spark, sf_dir), k_min=3)


@register("compare_methods", f"""{_SELECT_SQL},
ch AS (SELECT c.method, c.k_opt, coalesce(s.k_second, c.k_opt) AS k_second FROM c LEFT JOIN s ON c.method = s.method)
SELECT met.*, CASE WHEN met.k = ch.k_opt THEN 'best' WHEN met.k = ch.k_second THEN '2nd' ELSE '' END AS mark
FROM met JOIN ch ON met.method = ch.method""")
def compare_methods(spark, sf_dir):
    """Every method and k with best / 2nd marks."""
    m = _metrics_df(spark, sf_dir)
    return validate.compare_methods(m, validate.select_k(m, k_min=3))


@register("relabel_by_score", f"""WITH {_PTS},
m AS (SELECT label, avg(x0) AS m FROM pts GROUP BY label),
r AS (SELECT label, row_number() OVER (ORDER BY m, label) - 1 AS new_label FROM m)
SELECT p.row_id, CAST(r.new_label AS BIGINT) AS new_label FROM pts p JOIN r ON p.label = r.label""")
def relabel_by_score(spark, sf_dir):
    """Labels renumbered 0..k−1 by ascending mean of a score (x0: a sum over every third dimension)."""
    p = embed_points(spark, sf_dir, 3)
    r = validate.relabel_by_score(p, "label", "x0", "new_label")
    return r.select("row_id", F.col("new_label").cast("long").alias("new_label"))


@register("nearest_centroid", f"""WITH {_PTS},
c AS (SELECT label, avg(x0) AS x0, avg(x1) AS x1, avg(x2) AS x2 FROM pts GROUP BY label),
d AS (SELECT a.row_id, b.label, (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)
             + (a.x2 - b.x2) * (a.x2 - b.x2) AS d2 FROM pts a, c b)
SELECT row_id, arg_min(label, (d2, label)) AS cluster FROM d GROUP BY row_id""")
def nearest_centroid(spark, sf_dir):
    """Every point to the nearest label centroid (centres as literals)."""
    p = embed_points(spark, sf_dir, 3)
    cents = [r.asDict() for r in validate.centroids(p, _X, "label").collect()]
    return validate.nearest_centroid(p, _X, cents, key="label").select("row_id", F.col("cluster").cast("long"))


_EPS = 0.3


@register("eps_neighbors", f"""WITH {_PTS}
SELECT a.row_id, CAST(count(*) AS BIGINT) AS n_neighbors FROM pts a JOIN pts b ON {_D} <= {_EPS}
GROUP BY a.row_id""")
def eps_neighbors(spark, sf_dir):
    """Number of points within ε (self included) by grid-cell equi-joins."""
    p = embed_points(spark, sf_dir, 3)
    return segment.eps_neighbor_counts(p, _X, _EPS, "row_id").select("row_id", F.col("n_neighbors").cast("long"))
