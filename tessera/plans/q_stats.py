"""Rank statistics queries: R4 competence profile (the flagship), average
ranks, Spearman, Kruskal–Wallis, hypothesis verdict, exact medians."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.stats import chi2_sf_by_df_sql, stars_sql
from tessera.operators import profile, quality, ranks
from tessera.plans.catalog import register, r6, sql_long
from tessera.plans.proxies import (SURVEY_ITEMS, SURVEY_SQL, survey, line_items,
                                   DOC_COLS, DOC_METRICS_SQL, doc_metrics)
from tessera.sources.tables import load

# survey items validated to the Likert range [1, 5]
_VALID_SQL = ("v AS (SELECT row_id, seg, "
              + ", ".join(f"CASE WHEN {c} BETWEEN 1 AND 5 THEN {c} END AS {c}" for c in SURVEY_ITEMS)
              + " FROM survey)")


def _kw_sql(long_cte: str, group: str) -> str:
    """Kruskal–Wallis in plain SQL: rank() + ties, rank sums, closed-form tail."""
    return f"""{long_cte},
rk AS (SELECT var, val, {group},
              rank() OVER (PARTITION BY var ORDER BY val)
              + (count(*) OVER (PARTITION BY var, val) - 1) / 2.0E0 AS r
       FROM long WHERE {group} IS NOT NULL),
g AS (SELECT var, {group}, sum(r) AS rs, count(*) AS ng FROM rk GROUP BY var, {group}),
tt AS (SELECT var, sum(c * c * c - c) AS t
       FROM (SELECT var, val, CAST(count(*) AS DOUBLE) AS c FROM long WHERE {group} IS NOT NULL GROUP BY var, val)
       GROUP BY var),
s AS (SELECT var, sum(rs * rs / ng) AS s, count(*) AS k, CAST(sum(ng) AS DOUBLE) AS n FROM g GROUP BY var),
hh AS (SELECT s.var, n, k,
              CASE WHEN k >= 2 AND 1 - t / (n * n * n - n) > 0
                   THEN (12.0E0 / (n * (n + 1)) * s - 3.0E0 * (n + 1)) / (1 - t / (n * n * n - n)) END AS h
       FROM s JOIN tt ON s.var = tt.var),
kw AS (SELECT var, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS n_groups, h,
              CASE WHEN h IS NOT NULL THEN CAST(k - 1 AS BIGINT) END AS df,
              {chi2_sf_by_df_sql('h', 'CASE WHEN h IS NOT NULL THEN k - 1 END')} AS p_value
       FROM hh)"""


# ---------------------------------------------------------------------------
# R4 — the flagship: validate → grouped means → Kruskal–Wallis → stars
# ---------------------------------------------------------------------------

def competence_profile_df(s, items, group_col):
    v = quality.range_validate(s, items, 1, 5)
    gh = ranks.group_histogram(v, items, group_col)          # one scan feeds both
    means = ranks.group_means_from_histogram(gh, group_col)
    kw = ranks.kruskal_from_histogram(gh, group_col)
    return (means.join(kw.select("var", "h", "p_value"), "var")
            .withColumn("stars", F.expr(stars_sql("p_value")))
            .select("var", group_col, "n", r6("mean").alias("mean"), r6("h").alias("h"),
                    r6("p_value").alias("p_value"), "stars"))


_PROFILE_SQL = f"""WITH {SURVEY_SQL}, {_VALID_SQL},
{_kw_sql("long AS (" + sql_long("v", SURVEY_ITEMS, ["seg"]) + ")", "seg")},
m AS (SELECT var, seg, count(*) AS n, avg(val) AS mean FROM long WHERE seg IS NOT NULL GROUP BY var, seg)
SELECT m.var, m.seg, m.n, round(m.mean, 6) AS mean, round(kw.h, 6) AS h,
       round(kw.p_value, 6) AS p_value, {stars_sql('kw.p_value')} AS stars
FROM m JOIN kw ON m.var = kw.var"""


@register("competence_profile", _PROFILE_SQL)
def competence_profile(spark, sf_dir):
    """Per-segment means of the Likert items with KW p and stars."""
    return competence_profile_df(survey(spark, sf_dir), SURVEY_ITEMS, "seg")


# ---------------------------------------------------------------------------
# Kruskal–Wallis on lineitem (3 groups) and events (5 groups)
# ---------------------------------------------------------------------------

_LI_COLS = ["l_quantity", "l_discount", "l_tax"]


def _kw_out(kw):
    return kw.select("var", "n", "n_groups", r6("h").alias("h"), "df", r6("p_value").alias("p_value"),
                     F.expr(stars_sql("p_value")).alias("stars"))


_KW_LI_SQL = f"""WITH {_kw_sql("long AS (" + sql_long("lineitem", _LI_COLS, ["l_returnflag AS seg"]) + ")", "seg")}
SELECT var, n, n_groups, round(h, 6) AS h, df, round(p_value, 6) AS p_value,
       {stars_sql('p_value')} AS stars FROM kw"""


@register("kruskal_wallis", _KW_LI_SQL)
def kruskal_wallis_q(spark, sf_dir):
    """Lineitem measures across return flags (3 groups → p = exp(-H/2))."""
    li = line_items(spark, sf_dir)
    return _kw_out(ranks.kruskal_wallis(li, _LI_COLS, "seg"))


_KW_EV_SQL = f"""WITH {_kw_sql("long AS (" + sql_long("events", ["value"], ["event_type AS seg"]) + ")", "seg")}
SELECT var, n, n_groups, round(h, 6) AS h, df, round(p_value, 6) AS p_value,
       {stars_sql('p_value')} AS stars FROM kw"""


@register("kruskal_wallis_5", _KW_EV_SQL)
def kruskal_wallis_5(spark, sf_dir):
    """M23 with 5 groups (df 4) over events.value by event_type."""
    ev = load(spark, sf_dir, "events").select(F.col("event_type").alias("seg"), "value")
    return _kw_out(ranks.kruskal_wallis(ev, ["value"], "seg"))


_KW_DOC_SQL = f"""WITH {_kw_sql("long AS (" + sql_long("documents", ["n_chars"], ["lang AS seg"]) + ")", "seg")}
SELECT var, n, n_groups, round(h, 6) AS h, df, round(p_value, 6) AS p_value,
       {stars_sql('p_value')} AS stars FROM kw"""


@register("kruskal_wallis_4", _KW_DOC_SQL)
def kruskal_wallis_4(spark, sf_dir):
    """M23 with 4 groups (df 3, the odd branch of the χ² tail): document length by language."""
    d = load(spark, sf_dir, "documents").select(F.col("lang").alias("seg"), "n_chars")
    return _kw_out(ranks.kruskal_wallis(d, ["n_chars"], "seg"))


_VERDICT_SQL = f"""WITH {SURVEY_SQL},
base AS (SELECT seg, datediff('day', dt, TIMESTAMP '2026-01-01 00:00:00') / 365.25E0 AS age FROM survey),
b2 AS (SELECT seg, CASE WHEN age BETWEEN 18 AND 80 THEN age END AS age FROM base),
{_kw_sql("long AS (" + sql_long("b2", ["age"], ["seg"]) + ")", "seg")},
mm AS (SELECT seg, avg(age) AS m FROM b2 WHERE seg IS NOT NULL GROUP BY seg),
top AS (SELECT arg_max(seg, m) AS top_group, max(m) AS top_mean FROM mm)
SELECT kw.var, kw.n, kw.n_groups, round(kw.h, 6) AS h, kw.df, round(kw.p_value, 6) AS p_value,
       top.top_group, round(top.top_mean, 6) AS top_mean,
       CASE WHEN kw.p_value IS NULL THEN NULL WHEN kw.p_value < 0.05E0 THEN 'confirmada'
            ELSE 'no confirmada' END AS verdict
FROM kw, top"""


@register("hypothesis_verdict", _VERDICT_SQL)
def hypothesis_verdict(spark, sf_dir):
    """Age (years from graduation date to 2026-01-01, 18–80) by segment."""
    s = survey(spark, sf_dir)
    age = (F.datediff(F.lit("2026-01-01").cast("date"), F.col("dt").cast("date")) / 365.25)
    b = s.select("seg", F.when(age.between(18, 80), age).alias("age"))
    v = ranks.hypothesis_verdict(b, "age", "seg")
    return v.select("var", "n", "n_groups", r6("h").alias("h"), "df", r6("p_value").alias("p_value"),
                    "top_group", r6("top_mean").alias("top_mean"), "verdict")


# ---------------------------------------------------------------------------
# average ranks and Spearman
# ---------------------------------------------------------------------------

_AVG_RANK_SQL = f"""WITH long AS ({sql_long("lineitem", _LI_COLS)})
SELECT var, val, CAST(count(*) AS BIGINT) AS cnt,
       round(min(r) + (count(*) - 1) / 2.0E0, 6) AS avg_rank
FROM (SELECT var, val, rank() OVER (PARTITION BY var ORDER BY val) AS r FROM long)
GROUP BY var, val"""


@register("avg_rank", _AVG_RANK_SQL)
def avg_rank(spark, sf_dir):
    """Average rank of every distinct value of three lineitem measures."""
    li = line_items(spark, sf_dir)
    r = ranks.average_ranks(ranks.to_long(li, _LI_COLS), ["var"])
    return r.select("var", "val", "cnt", r6("avg_rank").alias("avg_rank"))


def _spearman_sql(src_cte: str, cols: list[str]) -> str:
    rank_cols = ",\n  ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0E0 AS {c}"
        for c in cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    sel = "\nUNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS rho FROM rk" for a, b in pairs)
    return f"WITH {src_cte},\nrk AS (SELECT\n  {rank_cols}\nFROM src)\n{sel}"


_SPEARMAN_SQL = _spearman_sql(f"{DOC_METRICS_SQL}, src AS (SELECT * FROM docm)", DOC_COLS)


@register("spearman_matrix", _SPEARMAN_SQL)
def spearman_matrix(spark, sf_dir):
    """M4: Spearman = Pearson of average ranks, documents metrics block."""
    d = doc_metrics(spark, sf_dir)
    rk = ranks.rank_columns(d, DOC_COLS, "row_id")
    return profile.corr_pairs(rk, DOC_COLS).select("var1", "var2", r6("r").alias("rho"))


_MEDIAN_SQL = f"""WITH long AS ({sql_long("lineitem", _LI_COLS, ["l_returnflag AS seg"])})
SELECT seg, var, round(quantile_cont(val, 0.5), 6) AS median FROM long GROUP BY seg, var"""


@register("exact_median", _MEDIAN_SQL)
def exact_median(spark, sf_dir):
    """Exact median per segment and measure (ranked histogram)."""
    li = line_items(spark, sf_dir)
    m = ranks.exact_median(li, _LI_COLS, ["seg"])
    return m.select("seg", "var", r6("median").alias("median"))
