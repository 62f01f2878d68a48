"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile, quality
from tessera.plans.catalog import register, r6, sql_long
from tessera.plans.proxies import (DOC_COLS, DOC_METRICS_SQL, SURVEY_ITEMS, SURVEY_SQL, doc_metrics,
                                   line_items, survey)
from tessera.sources.tables import load

_VALID = ", ".join(f"CASE WHEN {c} BETWEEN 1 AND 5 THEN {c} END AS {c}" for c in SURVEY_ITEMS)


def _valid_survey(spark, sf_dir):
    return quality.range_validate(survey(spark, sf_dir), SURVEY_ITEMS, 1, 5)


@register("freq_share", f"""WITH {SURVEY_SQL}
SELECT site AS value, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM survey WHERE site IS NOT NULL GROUP BY site""")
def freq_share(spark, sf_dir):
    """Frequency and share of total (nulls excluded)."""
    f = profile.freq_share(survey(spark, sf_dir), "site")
    return f.select("value", "n", r6("share").alias("share"))


@register("freq_share_by_group", f"""WITH {SURVEY_SQL}
SELECT seg, t1 AS value, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY seg), 6) AS share
FROM survey WHERE t1 IS NOT NULL GROUP BY seg, t1""")
def freq_share_by_group(spark, sf_dir):
    """Distribution of an answer within each segment."""
    f = profile.freq_share(survey(spark, sf_dir), "t1", "seg")
    return f.select("seg", "value", "n", r6("share").alias("share"))


@register("top_n_global", f"""WITH {SURVEY_SQL}
SELECT site AS value, CAST(count(*) AS BIGINT) AS n FROM survey WHERE site IS NOT NULL
GROUP BY site ORDER BY n DESC, value LIMIT 8""")
def top_n_global(spark, sf_dir):
    """O2, O1: the 8 most frequent sites (top-k is the feature)."""
    return profile.top_n(survey(spark, sf_dir), "site", 8)


@register("top_n_per_group", f"""WITH {SURVEY_SQL},
p AS (SELECT seg, site AS value, count(*) AS n FROM survey WHERE site IS NOT NULL AND seg IS NOT NULL
      GROUP BY seg, site),
r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY n DESC, value) AS rk,
             sum(n) OVER (PARTITION BY seg) AS g, sum(n) OVER (PARTITION BY value) AS v FROM p)
SELECT seg, CAST(rk AS BIGINT) AS rank, value, CAST(n AS BIGINT) AS n,
       round(100.0E0 * n / g, 6) AS pct_group, round(100.0E0 * n / v, 6) AS pct_value
FROM r WHERE rk <= 5""")
def top_n_per_group(spark, sf_dir):
    """Top 5 sites per segment with share of segment and of site."""
    t = profile.top_n_per_group(survey(spark, sf_dir), "site", "seg", 5)
    return t.select("seg", "rank", "value", "n", r6("pct_group").alias("pct_group"),
                    r6("pct_value").alias("pct_value"))


@register("crosstab_row_pct", f"""WITH {SURVEY_SQL},
p AS (SELECT seg, cat_program, count(*) AS n FROM survey WHERE seg IS NOT NULL AND cat_program IS NOT NULL
      GROUP BY seg, cat_program)
SELECT seg, cat_program, CAST(n AS BIGINT) AS n, round(100.0E0 * n / sum(n) OVER (PARTITION BY seg), 6) AS pct
FROM p""")
def crosstab_row_pct(spark, sf_dir):
    """Segment × category, row-normalised percentages."""
    c = profile.crosstab_row_pct(survey(spark, sf_dir), "seg", "cat_program")
    return c.select("seg", "cat_program", "n", r6("pct").alias("pct"))


@register("inverse_marginal", f"""WITH {SURVEY_SQL},
t AS (SELECT site FROM survey WHERE site IS NOT NULL GROUP BY site ORDER BY count(*) DESC, site LIMIT 8),
p AS (SELECT s.site, s.seg, count(*) AS n FROM survey s JOIN t ON s.site = t.site
      WHERE s.seg IS NOT NULL GROUP BY s.site, s.seg)
SELECT site, seg, CAST(n AS BIGINT) AS n, round(100.0E0 * n / sum(n) OVER (PARTITION BY site), 6) AS pct FROM p""")
def inverse_marginal(spark, sf_dir):
    """For the 8 biggest sites, where their respondents fall by segment."""
    c = profile.inverse_marginal(survey(spark, sf_dir), "site", "seg", 8)
    return c.select("site", "seg", "n", r6("pct").alias("pct"))


_LI = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@register("describe_many", f"""WITH long AS ({sql_long("lineitem", _LI)})
SELECT var, CAST(count(*) AS BIGINT) AS n, round(avg(val), 6) AS mean, round(stddev_samp(val), 6) AS std,
       min(val) AS min, max(val) AS max FROM long GROUP BY var""")
def describe_many(spark, sf_dir):
    """A3: count, mean, std (ddof 1), min, max of many measures in one scan."""
    d = profile.describe_many(line_items(spark, sf_dir), _LI)
    return d.select("var", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max")


@register("grouped_stats", """SELECT l_returnflag AS seg, CAST(count(*) AS BIGINT) AS n,
  round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS median,
  round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max
FROM lineitem GROUP BY l_returnflag""")
def grouped_stats(spark, sf_dir):
    """N, mean, exact median, std, min, max per segment."""
    g = profile.grouped_stats(line_items(spark, sf_dir), "l_quantity", "seg")
    return g.select("seg", "n", r6("mean").alias("mean"), r6("median").alias("median"),
                    r6("std").alias("std"), "min", "max")


@register("grouped_means", f"""WITH {SURVEY_SQL}, v AS (SELECT seg, {_VALID} FROM survey),
long AS ({sql_long("v", SURVEY_ITEMS, ["seg"])})
SELECT var, seg, CAST(count(*) AS BIGINT) AS n, round(avg(val), 6) AS mean FROM long
WHERE seg IS NOT NULL GROUP BY var, seg""")
def grouped_means(spark, sf_dir):
    """Mean of many items per segment, one scan."""
    g = profile.grouped_means(_valid_survey(spark, sf_dir), SURVEY_ITEMS, "seg")
    return g.select("var", "seg", "n", r6("mean").alias("mean"))


@register("mean_extremes", f"""WITH {SURVEY_SQL}, v AS (SELECT {_VALID} FROM survey),
m AS (SELECT var, avg(val) AS mean FROM ({sql_long("v", SURVEY_ITEMS)}) GROUP BY var)
SELECT arg_max(var, mean) AS max_var, round(max(mean), 6) AS max_mean,
       arg_min(var, mean) AS min_var, round(min(mean), 6) AS min_mean FROM m""")
def mean_extremes(spark, sf_dir):
    """Item with the highest and the lowest mean (max_by / min_by)."""
    a = profile.arg_extremes(_valid_survey(spark, sf_dir), SURVEY_ITEMS)
    return a.select("max_var", r6("max_mean").alias("max_mean"), "min_var", r6("min_mean").alias("min_mean"))


@register("strengths_gaps", f"""WITH {SURVEY_SQL}, v AS (SELECT seg, {_VALID} FROM survey),
m AS (SELECT var, seg, avg(val) AS mean FROM ({sql_long("v", SURVEY_ITEMS, ["seg"])}) WHERE seg IS NOT NULL
      GROUP BY var, seg),
r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY mean DESC, var) AS rt,
                row_number() OVER (PARTITION BY seg ORDER BY mean ASC, var) AS rb FROM m)
SELECT seg, 'top' AS side, CAST(rt AS BIGINT) AS rank, var, round(mean, 6) AS mean FROM r WHERE rt <= 3
UNION ALL
SELECT seg, 'bottom', CAST(rb AS BIGINT), var, round(mean, 6) FROM r WHERE rb <= 3""")
def strengths_gaps(spark, sf_dir):
    """Strongest and weakest 3 items per segment."""
    m = profile.mean_extremes(_valid_survey(spark, sf_dir), SURVEY_ITEMS, "seg", 3)
    return m.select("seg", "side", "rank", "var", r6("mean").alias("mean"))


@register("yes_share", f"""WITH {SURVEY_SQL}
SELECT var, seg, CAST(count(*) FILTER (WHERE val = 'Si') AS BIGINT) AS n_yes,
       CAST(count(*) FILTER (WHERE val IN ('Si', 'No')) AS BIGINT) AS n_answered,
       round(CASE WHEN count(*) FILTER (WHERE val IN ('Si', 'No')) > 0
             THEN 100.0E0 * count(*) FILTER (WHERE val = 'Si') / count(*) FILTER (WHERE val IN ('Si', 'No')) END, 6)
         AS pct_yes
FROM (SELECT seg, 'b1' AS var, b1 AS val FROM survey UNION ALL SELECT seg, 'b2', b2 FROM survey)
WHERE seg IS NOT NULL GROUP BY var, seg""")
def yes_share(spark, sf_dir):
    """% answering 'Si' among Si/No answers per segment."""
    y = profile.yes_share(survey(spark, sf_dir), ["b1", "b2"], "seg")
    return y.select("var", "seg", "n_yes", "n_answered", r6("pct_yes").alias("pct_yes"))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS_SQL = "p AS (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r FROM lineitem"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]) + ")"


@register("corr_matrix_top_pairs", f"""WITH {_PAIRS_SQL}
SELECT var1, var2, round(r, 6) AS r FROM p ORDER BY abs(r) DESC, var1, var2 LIMIT 5""")
def corr_matrix_top_pairs(spark, sf_dir):
    """Pairwise Pearson of the line items' measures, strongest 5 pairs."""
    return profile.top_corr_pairs(line_items(spark, sf_dir), _CORR, 5).select("var1", "var2", r6("r").alias("r"))


@register("corr_mean", f"""WITH {_PAIRS_SQL}
SELECT count(r) AS n_pairs, round(avg(r), 6) AS mean_r, round(avg(abs(r)), 6) AS mean_abs_r FROM p""")
def corr_mean(spark, sf_dir):
    """Mean correlation over all pairs."""
    m = profile.mean_corr(line_items(spark, sf_dir), _CORR)
    return m.select("n_pairs", r6("mean_r").alias("mean_r"), r6("mean_abs_r").alias("mean_abs_r"))


@register("doc_corr", f"""WITH {DOC_METRICS_SQL}
SELECT count(*) AS n_pairs, round(avg(r), 6) AS mean_r FROM (
  SELECT corr(n_chars, n_words) AS r FROM docm UNION ALL SELECT corr(n_chars, n_lines) FROM docm
  UNION ALL SELECT corr(n_words, n_lines) FROM docm)""")
def doc_corr(spark, sf_dir):
    """Mean correlation of the document metrics."""
    m = profile.mean_corr(doc_metrics(spark, sf_dir), DOC_COLS)
    return m.select("n_pairs", r6("mean_r").alias("mean_r"))


@register("box_summary", f"""WITH long AS ({sql_long("lineitem", ["l_quantity", "l_extendedprice"])}),
q AS (SELECT var, quantile_cont(val, 0.25) AS q1, quantile_cont(val, 0.5) AS median,
             quantile_cont(val, 0.75) AS q3, count(*) AS n, min(val) AS mn, max(val) AS mx FROM long GROUP BY var),
f AS (SELECT *, q1 - 1.5E0 * (q3 - q1) AS lo_fence, q3 + 1.5E0 * (q3 - q1) AS hi_fence FROM q)
SELECT f.var, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(lo_fence, 6) AS lo_fence, round(hi_fence, 6) AS hi_fence, CAST(n AS BIGINT) AS n,
       mn AS min, mx AS max,
       CAST((SELECT count(*) FROM long l WHERE l.var = f.var AND (l.val < f.lo_fence OR l.val > f.hi_fence))
            AS BIGINT) AS n_outliers
FROM f""")
def box_summary(spark, sf_dir):
    """Exact quartiles, 1.5·IQR fences, outlier count."""
    b = profile.box_summary(line_items(spark, sf_dir), ["l_quantity", "l_extendedprice"])
    return b.select("var", r6("q1").alias("q1"), r6("median").alias("median"), r6("q3").alias("q3"),
                    r6("lo_fence").alias("lo_fence"), r6("hi_fence").alias("hi_fence"), "n", "min", "max",
                    "n_outliers")


# --- fixed values: proxy bins ----------------------------------------------
_EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]
_LABELS = ["(0,10]", "(10,20]", "(20,30]", "(30,40]", "(40,50]"]
# --------------------------------------------------------------------------


@register("bin_histogram", """SELECT bin, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN '(0,10]'
              WHEN l_quantity > 10 AND l_quantity <= 20 THEN '(10,20]'
              WHEN l_quantity > 20 AND l_quantity <= 30 THEN '(20,30]'
              WHEN l_quantity > 30 AND l_quantity <= 40 THEN '(30,40]'
              WHEN l_quantity > 40 AND l_quantity <= 50 THEN '(40,50]' END AS bin FROM lineitem)
WHERE bin IS NOT NULL GROUP BY bin""")
def bin_histogram(spark, sf_dir):
    """Right-closed labelled bins and counts."""
    return profile.bin_histogram(line_items(spark, sf_dir), "l_quantity", _EDGES, _LABELS)


@register("prefix_sums", """SELECT column_name, total FROM (
  SELECT 'seg_F' AS column_name, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS total FROM orders
  UNION ALL SELECT 'seg_O', CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) FROM orders
  UNION ALL SELECT 'seg_P', CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) FROM orders)""")
def prefix_sums(spark, sf_dir):
    """Sums of one-hot columns found by prefix."""
    o = load(spark, sf_dir, "orders")
    oh = o.select(*[(F.col("o_orderstatus") == s).cast("long").alias(f"seg_{s}") for s in ("F", "O", "P")])
    return profile.prefix_sums(oh, "seg_").withColumn("total", F.col("total").cast("long"))


_DENS_GRID = 20


@register("group_density", f"""WITH e AS (SELECT event_type AS seg, value AS x FROM events),
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM e),
st AS (SELECT seg, count(*) AS n, stddev_samp(x) * pow(CAST(count(*) AS DOUBLE), -0.2E0) AS h FROM e GROUP BY seg),
g AS (SELECT i AS g, lo + i * ((hi - lo) / {_DENS_GRID - 1}) AS gx FROM rng, range(0, {_DENS_GRID}) t(i))
SELECT e.seg, CAST(g.g AS INTEGER) AS g, round(g.gx, 6) AS x,
       round(sum(exp(-0.5E0 * pow((g.gx - e.x) / st.h, 2))) * (1.0E0 / sqrt(2.0E0 * pi())) / (st.n * st.h), 6)
         AS density
FROM e JOIN st ON e.seg = st.seg CROSS JOIN g GROUP BY e.seg, g.g, g.gx, st.n, st.h""")
def group_density(spark, sf_dir):
    """Gaussian kernel density per segment on a 20-point grid (one aggregation)."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("seg"), "value")
    d = profile.group_density(e, "value", "seg", _DENS_GRID)
    return d.select("seg", "g", r6("x").alias("x"), r6("density").alias("density"))


@register("low_share", f"""WITH {SURVEY_SQL}, v AS (SELECT {_VALID} FROM survey)
SELECT var, CAST(count(*) AS BIGINT) AS n,
       round(100.0E0 * count(*) FILTER (WHERE val <= 2) / count(*), 6) AS pct_low
FROM ({sql_long("v", SURVEY_ITEMS)}) GROUP BY var""")
def low_share(spark, sf_dir):
    """R17 item focus: share of answers ≤ 2 among answered."""
    ls = profile.low_share(_valid_survey(spark, sf_dir), SURVEY_ITEMS, 2.0)
    return ls.select("var", "n", r6("pct_low").alias("pct_low"))
