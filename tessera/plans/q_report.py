"""Table B flow (R19, R20, F6–F8, E6–E19 on the study's own scales) and the report sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import encode
from tessera.operators import report as rp
from tessera.plans import flows
from tessera.plans import survey_config as cfg
from tessera.plans.catalog import register, r6, sql_long
from tessera.plans.proxies import (B_COLUMNS, B_SALARY, B_SCALES, SURVEY_ITEMS, SURVEY_SQL, embed_points,
                                   embed_points_sql, line_items, scale_sql, survey, survey_b, survey_b_sql)
from tessera.plans.q_stats import _kw_sql
from tessera.sources.scratch import saved

_NO = cfg.NOT_APPLICABLE
_ATTAINMENT = list(cfg.ATTAINMENT_SCALE) + [_NO]
_INCIDENCE = list(cfg.INCIDENCE_SCALE) + [_NO]
_SPEC_B = flows.IngestSpecB(pii_cols=["consentimiento"], key_col="cedula",
                            allowed={"logro_1": _ATTAINMENT, "logro_2": _ATTAINMENT, "incidencia": _INCIDENCE},
                            binary_cols=["laborando"])


def _texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _b_clean(c: str) -> str:
    if c in _SPEC_B.allowed:
        return f"CASE WHEN {c} IN ({_texts(v for v in _SPEC_B.allowed[c] if v != _NO)}) THEN {c} END AS {c}"
    if c in _SPEC_B.binary_cols:
        return f"CASE WHEN {c} IN ({_texts(_SPEC_B.binary_values)}) THEN {c} END AS {c}"
    return c


_ALL_B = ", ".join(["seg", "cedula", *B_COLUMNS, "vacia"])
_B_CTE = f"""{survey_b_sql()},
ex AS (SELECT min(row_id) AS row_id, {_ALL_B} FROM survey_b GROUP BY {_ALL_B}),
ky AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cedula ORDER BY row_id) AS rn FROM ex) WHERE rn = 1),
cb AS (SELECT row_id, seg, cedula, {', '.join(_b_clean(c) for c in B_COLUMNS)} FROM ky)"""


def _clean_b(spark, sf_dir):
    return flows.ingest_b(survey_b(spark, sf_dir), _SPEC_B)


@register("ingest_b_flow", f"WITH {_B_CTE}\nSELECT * FROM cb")
def ingest_b_flow(spark, sf_dir):
    """R19 (B): PII → exact duplicates → key duplicates → sparse columns → ordinal sets → token → binaries."""
    return _clean_b(spark, sf_dir)[0].select("row_id", "seg", "cedula", *B_COLUMNS)


@register("quality_report_b", f"""WITH {_B_CTE}
SELECT (SELECT count(*) FROM survey_b) AS n_rows_raw, CAST({len(B_COLUMNS) + 5} AS BIGINT) AS n_cols_raw,
       CAST(1 AS BIGINT) AS n_pii_dropped, (SELECT count(*) FROM survey_b) - (SELECT count(*) FROM ex) AS n_duplicates,
       (SELECT count(*) FROM ex) - (SELECT count(*) FROM ky) AS n_key_duplicates, CAST(1 AS BIGINT) AS n_sparse_cols,
       (SELECT count(*) FROM ky) AS n_rows_final, CAST({len(B_COLUMNS) + 3} AS BIGINT) AS n_cols_final""")
def quality_report_b(spark, sf_dir):
    """R1 (B): counts of every ingest step in one row."""
    return _clean_b(spark, sf_dir)[1]


def _b_issue_sql(check, c, allowed):
    return (f"SELECT '{check}' AS \"check\", '{c}' AS column_name, {c} AS bad_value, count(*) AS n_invalid FROM ky "
            f"WHERE {c} IS NOT NULL AND {c} NOT IN ({_texts(allowed)}) GROUP BY {c}")


_B_ISSUES = "\nUNION ALL ".join(
    [_b_issue_sql("ordinal", c, a) for c, a in _SPEC_B.allowed.items()]
    + [_b_issue_sql("binary", c, _SPEC_B.binary_values) for c in _SPEC_B.binary_cols]
    + [f"SELECT 'token', '{c}', '{_NO}', count(*) FROM ky WHERE {c} = '{_NO}' HAVING count(*) > 0"
       for c in _SPEC_B.allowed])


@register("ingest_b_issues", f"WITH {_B_CTE}\n{_B_ISSUES}")
def ingest_b_issues(spark, sf_dir):
    """F6–F8 (B): values outside each column's set, and the token's count, per column."""
    return _clean_b(spark, sf_dir)[2]


_FSPEC_B = flows.FeatureSpec(
    scales=dict(B_SCALES), binary={"laborando": (cfg.YES_B, cfg.NO_B)},
    coalesce={"salario": [(c, m) for c, m in B_SALARY]},
    nominal={"padres_clase": ("padres", cfg.PARENTS_EDUCATION, sorted(set(cfg.PARENTS_EDUCATION.values())), False),
             "genero_valido": ("genero", None, cfg.VALID_CATEGORIES["cat_genero"], False)},
    scores={"score_logro": ["logro_1", "logro_2"], "score_empleo": ["cargo", "contrato", "sector"],
            "score_percepcion": ["acuerdo", "suficiencia", "satisfaccion"]},
    lumps=[("padres_clase", 300, cfg.RARE_CATEGORY_LABEL), ("genero_valido", 3000, cfg.RARE_CATEGORY_LABEL)])


def _sum_sql(cols) -> str:
    return " + ".join(f"coalesce({c}, 0)" for c in cols)


_TRIM = "regexp_replace({c}, '^[\\s ]+|[\\s ]+$', '', 'g')"
_PARENT_SQL = "CASE " + _TRIM.format(c="padres") + " " + " ".join(
    f"WHEN '{t}' THEN '{v}'" for t, v in cfg.PARENTS_EDUCATION.items()) + " END"
_FB_CTE = f"""{_B_CTE},
f0 AS (SELECT row_id, seg, {', '.join(f"{scale_sql(c, m)} AS {c}" for c, m in B_SCALES.items())},
              CASE WHEN laborando IN ({_texts(cfg.YES_B)}) THEN 1 WHEN laborando IN ({_texts(cfg.NO_B)}) THEN 0 END AS laborando,
              coalesce({', '.join(scale_sql(c, m) for c, m in B_SALARY)}) AS salario,
              upper({_PARENT_SQL}) AS pv, CASE WHEN genero IN ({_texts(cfg.VALID_CATEGORIES['cat_genero'])}) THEN upper(genero) END AS gv
       FROM cb),
pc AS (SELECT pv, count(*) AS n FROM f0 GROUP BY pv), gc AS (SELECT gv, count(*) AS n FROM f0 GROUP BY gv),
fb AS (SELECT f0.*, CAST({_sum_sql(_FSPEC_B.scores['score_logro'])} AS DOUBLE) AS score_logro,
              CAST({_sum_sql(_FSPEC_B.scores['score_empleo'])} AS DOUBLE) AS score_empleo,
              CAST({_sum_sql(_FSPEC_B.scores['score_percepcion'])} AS DOUBLE) AS score_percepcion,
              CASE WHEN f0.pv IS NULL THEN NULL WHEN pc.n >= 300 THEN f0.pv ELSE 'Otro' END AS padres_clase,
              CASE WHEN f0.gv IS NULL THEN NULL WHEN gc.n >= 3000 THEN f0.gv ELSE 'Otro' END AS genero_valido
       FROM f0 LEFT JOIN pc ON pc.pv = f0.pv LEFT JOIN gc ON gc.gv = f0.gv)"""
_FB_COLS = ["row_id", "seg", *B_SCALES, "laborando", "salario", "score_logro", "score_empleo", "score_percepcion",
            "padres_clase", "genero_valido"]


def _features_b(spark, sf_dir):
    return flows.features(_clean_b(spark, sf_dir)[0], _FSPEC_B)


@register("features_b_flow", f"WITH {_FB_CTE}\nSELECT {', '.join(_FB_COLS)} FROM fb")
def features_b_flow(spark, sf_dir):
    """R20 (B), E3, E6–E8, E10–E19, E21: every scale of the study, salary bands coalesced, nominal
    cleaning, three scores, two lumps."""
    codes = {*B_SCALES, "laborando", "salario"}
    return _features_b(spark, sf_dir).select(*[F.col(c).cast("int").alias(c) if c in codes else F.col(c)
                                               for c in _FB_COLS])


# ---------------------------------------------------------------------------
# report sections: each twin is built from the same few SQL shapes
# ---------------------------------------------------------------------------

def _long_rows(src: str, section: str, item: str, segment: str, stats: dict) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{section}' AS section, {item} AS item, {segment} AS segment, '{k}' AS stat, CAST({v} AS DOUBLE) AS value FROM {src}"
        for k, v in stats.items())


def _profile_rows(cte: str, items: list[str], section: str) -> str:
    """Means per segment and the rank test of several items."""
    kw = _kw_sql("long AS (" + sql_long(cte, items, ["seg"]) + ")", "seg")
    return f"""SELECT * FROM (WITH {kw},
m AS (SELECT var, seg, count(*) AS n, avg(val) AS mean FROM long WHERE seg IS NOT NULL GROUP BY var, seg)
{_long_rows("m", section, "var", "seg", {"n": "n", "mean": "mean"})}
UNION ALL {_long_rows("kw", section, "var", "'TOTAL'", {"kw_h": "h", "kw_p": "p_value"})})"""


def _measure_rows(cte: str, col: str, section: str) -> str:
    kw = _kw_sql("long AS (" + sql_long(cte, [col], ["seg"]) + ")", "seg")
    return f"""SELECT * FROM (WITH {kw},
m AS (SELECT seg, count(*) AS n, avg(val) AS mean, quantile_cont(val, 0.5) AS median, stddev_samp(val) AS std,
             min(val) AS min, max(val) AS max FROM long WHERE seg IS NOT NULL GROUP BY seg)
{_long_rows("m", section, f"'{col}'", "seg", {k: k for k in ("n", "mean", "median", "std", "min", "max")})}
UNION ALL {_long_rows("kw", section, f"'{col}'", "'TOTAL'", {"kw_h": "h", "kw_p": "p_value"})})"""


def _dist_rows(cte: str) -> str:
    return f"""SELECT * FROM (WITH d AS (SELECT seg, count(*) AS n, 100.0E0 * count(*) / sum(count(*)) OVER () AS pct FROM {cte} WHERE seg IS NOT NULL GROUP BY seg)
{_long_rows("d", "distribution", "'seg'", "seg", {"n": "n", "pct": "pct"})})"""


def _programme_rows(cte: str, col: str) -> str:
    return f"""SELECT * FROM (WITH b AS (SELECT seg AS g, CASE WHEN {col} <> 'nan' THEN {col} END AS c FROM {cte}),
cv AS (SELECT count(c) AS n, 100.0E0 * count(c) / count(*) AS pct, count(DISTINCT c) AS d FROM b),
tc AS (SELECT c, count(*) AS n, 100.0E0 * count(*) / sum(count(*)) OVER () AS pct FROM b WHERE c IS NOT NULL GROUP BY c),
tp AS (SELECT * FROM tc ORDER BY n DESC, c LIMIT 8),
pg AS (SELECT g, c, count(*) AS n FROM b WHERE c IS NOT NULL AND g IS NOT NULL GROUP BY g, c),
rg AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, c) AS rk, 100.0E0 * n / sum(n) OVER (PARTITION BY g) AS pg_,
              100.0E0 * n / sum(n) OVER (PARTITION BY c) AS pp_ FROM pg),
r5 AS (SELECT * FROM rg WHERE rk <= 5),
iv AS (SELECT g, c, 100.0E0 * n / sum(n) OVER (PARTITION BY c) AS pct FROM pg WHERE c IN (SELECT c FROM tp))
{_long_rows("cv", "programme_coverage", f"'{col}'", "'TOTAL'", {"n": "n", "pct": "pct", "n_distinct": "d"})}
UNION ALL {_long_rows("tp", "programme_top", "c", "'TOTAL'", {"n": "n", "pct": "pct"})}
UNION ALL {_long_rows("r5", "programme_by_segment", "c", "g", {"rank": "rk", "n": "n", "pct_segment": "pg_", "pct_programme": "pp_"})}
UNION ALL {_long_rows("iv", "programme_inverse", "c", "g", {"pct": "pct"})})"""


def _mobility_rows(cte: str, col: str) -> str:
    return f"""SELECT * FROM (WITH m AS (SELECT coalesce(seg, 'TOTAL') AS seg, count(*) AS n,
  100.0E0 * count(*) FILTER (WHERE {col} > 0) / count(*) AS up, 100.0E0 * count(*) FILTER (WHERE {col} = 0) / count(*) AS same,
  100.0E0 * count(*) FILTER (WHERE {col} < 0) / count(*) AS down FROM {cte} WHERE {col} IS NOT NULL GROUP BY ROLLUP (seg))
{_long_rows("m", "mobility", f"'{col}'", "seg", {"n": "n", "pct_up": "up", "pct_same": "same", "pct_down": "down"})})"""


def _category_rows(cte: str, col: str, section: str) -> str:
    v = _TRIM.format(c=col)
    return f"""SELECT * FROM (WITH v AS (SELECT seg, CASE WHEN {v} NOT IN ('nan', 'None', '') AND NOT regexp_matches({v}, '^-*[0-9]+$') THEN {v} END AS c FROM {cte}),
t AS (SELECT seg, c, count(*) AS n, 100.0E0 * count(*) / sum(count(*)) OVER (PARTITION BY seg) AS pct FROM v
      WHERE seg IS NOT NULL AND c IS NOT NULL GROUP BY seg, c)
{_long_rows("t", section, f"'{col}=' || c", "seg", {"n": "n", "pct": "pct"})})"""


def _answer_rows(cte: str, cols: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT seg, '{c}' AS item, {c} AS a FROM {cte}" for c in cols)
    return f"""SELECT * FROM (WITH a AS (SELECT * FROM ({long}) WHERE seg IS NOT NULL AND a IN ('Si', 'No')),
s AS (SELECT item, seg, count(*) AS n, 100.0E0 * count(*) FILTER (WHERE a = 'Si') / count(*) AS y,
             100.0E0 * count(*) FILTER (WHERE a = 'No') / count(*) AS o FROM a GROUP BY item, seg)
{_long_rows("s", "answers", "item", "seg", {"n": "n", "pct Si": "y", "pct No": "o"})})"""


_V_SQL = """rv AS (SELECT row_id, seg, site, cat_program, b1, b2, CASE WHEN q1 BETWEEN 1 AND 5 THEN q1 END AS q1,
  CASE WHEN q2 BETWEEN 1 AND 5 THEN q2 END AS q2, CASE WHEN q3 BETWEEN 1 AND 5 THEN q3 END AS q3,
  CASE WHEN q4 BETWEEN 1 AND 5 THEN q4 END AS q4,
  CAST(CASE b1 WHEN 'Si' THEN 1 WHEN 'No' THEN 0 END AS DOUBLE) AS b1_code,
  coalesce(CASE b1 WHEN 'Si' THEN 1.0E0 WHEN 'No' THEN 0.0E0 END, 0.0E0)
    + coalesce(CASE b2 WHEN 'SI' THEN 1.0E0 WHEN 'no' THEN 0.0E0 END, 0.0E0) AS score,
  CAST(year(dt) AS DOUBLE) AS year,
  CASE WHEN datediff('day', CAST(dt AS DATE), DATE '2026-01-01') / 365.25E0 BETWEEN 18 AND 80
       THEN datediff('day', CAST(dt AS DATE), DATE '2026-01-01') / 365.25E0 END AS age, CASE WHEN q1 BETWEEN 1 AND 5 AND q2 BETWEEN 1 AND 5 THEN q2 - q1 END AS mob FROM survey)"""


def _robustness_rows(cte: str, a: str, b: str) -> str:
    return f"""SELECT * FROM (WITH c AS (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS nij FROM {cte}
  WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
t AS (SELECT sum(nij * (nij - 1) / 2) AS sij, sum(nij) AS n FROM c),
ra AS (SELECT sum(ai * (ai - 1) / 2) AS sa FROM (SELECT sum(nij) AS ai FROM c GROUP BY a)),
cb AS (SELECT sum(bj * (bj - 1) / 2) AS sb FROM (SELECT sum(nij) AS bj FROM c GROUP BY b)),
r AS (SELECT n, (sij - sa * sb / (n * (n - 1) / 2)) / (0.5 * (sa + sb) - sa * sb / (n * (n - 1) / 2)) AS ari FROM t, ra, cb)
{_long_rows("r", "robustness", f"'{a} / {b}'", "'TOTAL'", {"n": "n", "ari": "ari"})})"""


def _report_table(spark, sf_dir):
    from tessera.operators import quality
    s = quality.range_validate(survey(spark, sf_dir), SURVEY_ITEMS, 1, 5)
    b1 = encode.binary_encode("b1", cfg.YES_A, cfg.NO_A)
    b2 = encode.binary_encode("b2", cfg.YES_A, cfg.NO_A)
    s = s.withColumn("b1_code", b1.cast("double")).withColumn("b2_code", b2.cast("double"))
    return saved(s.withColumn("score", encode.additive_score(["b1_code", "b2_code"]))
                 .withColumn("year", F.year("dt").cast("double")).withColumn("age", encode.age_years("dt"))
                 .withColumn("mob", encode.change_score("q2", "q1", 1, 5)), "report")


_WELLBEING_ROWS = [
    _measure_rows("rv", "score", "wellbeing_score"),
    "SELECT * FROM (WITH m AS (SELECT seg, 100.0E0 * avg(b1_code) AS p FROM rv WHERE seg IS NOT NULL "
    "AND b1_code IS NOT NULL GROUP BY seg) "
    + _long_rows("m", "wellbeing_yes", "'b1_code'", "seg", {"pct": "p"}) + ")",
    _profile_rows("rv", ["q1", "q2"], "wellbeing_items")]
_SECTIONS = {
    "report_wellbeing": (lambda d: rp.wellbeing(d, "score", ["b1_code"], ["q1", "q2"], "seg"), _WELLBEING_ROWS, "R5"),
    "report_incidence": (lambda d: rp.item_profile(d, ["q3", "q4"], "seg", "incidence"),
                         [_profile_rows("rv", ["q3", "q4"], "incidence")], "R6"),
    "report_programme": (lambda d: rp.programme(d, "cat_program", "seg"), [_programme_rows("rv", "cat_program")], "R7"),
    "report_year": (lambda d: rp.measure(d, "year", "seg", "graduation_year"),
                    [_measure_rows("rv", "year", "graduation_year")], "R9"),
    "report_history": (lambda d: rp.item_profile(d, ["q2", "q4", "mob"], "seg", "history").unionByName(
        rp.yes_rates(d, ["b1"], "seg", "answers")), [_profile_rows("rv", ["q2", "q4", "mob"], "history"),
                                                     _answer_rows("rv", ["b1"])], "R10, A9"),
    "report_site": (lambda d: rp.categorical(d, ["site"], "seg", "site_effect"),
                    [_category_rows("rv", "site", "site_effect")], "R14, F10"),
}


def _section_query(name, build, rows, ids):
    sql = f"WITH {SURVEY_SQL}, {_V_SQL}\nSELECT section, item, segment, stat, round(value, 6) AS value FROM (" \
        + "\nUNION ALL ".join(rows) + ")"

    def run(spark, sf_dir):
        return build(_report_table(spark, sf_dir)).withColumn("value", r6("value"))
    run.__name__, run.__doc__ = name, f"{ids}: report section as a long table."
    register(name, sql)(run)


for _name, (_build, _rows, _ids) in _SECTIONS.items():
    _section_query(_name, _build, _rows, _ids)

_REPORT_SPEC = flows.ReportSpec(seg="seg", competences=["q1", "q2"], incidence=["q3"], programme="cat_program",
                                score="score", binary=["b1_code"], satisfaction=["q1", "q2"], age="age",
                                year="year", history=["q4", "mob"], answers=["b1"], mobility="mob",
                                categories=["cat_program"], site="site", labelings=("seg", "cat_program"))
_section_query("report_full", lambda d: flows.report(d, _REPORT_SPEC), [
    _dist_rows("rv"), _profile_rows("rv", ["q1", "q2"], "competences"), _profile_rows("rv", ["q3"], "incidence"),
    *_WELLBEING_ROWS, _measure_rows("rv", "age", "age"), _robustness_rows("rv", "seg", "cat_program"),
    _programme_rows("rv", "cat_program"), _measure_rows("rv", "year", "graduation_year"),
    _profile_rows("rv", ["q4", "mob"], "history"), _answer_rows("rv", ["b1"]), _mobility_rows("rv", "mob"),
    _category_rows("rv", "cat_program", "categorical"), _category_rows("rv", "site", "site_effect")], "R22, R3–R14")


_EDA = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_EDA_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS v1, '{b}' AS v2, corr({a}, {b}) AS r FROM lineitem"
                                for i, a in enumerate(_EDA) for b in _EDA[i + 1:])


@register("report_eda", f"""WITH lg AS ({sql_long("lineitem", _EDA)}),
d AS (SELECT var, count(*) AS n, avg(val) AS mean, stddev_samp(val) AS std, min(val) AS min, max(val) AS max,
             100.0E0 * count(*) FILTER (WHERE val <= 2) / count(*) AS low FROM lg GROUP BY var),
p AS ({_EDA_PAIRS}), t AS (SELECT * FROM p ORDER BY abs(r) DESC, v1, v2 LIMIT 5),
a AS (SELECT avg(r) AS m, avg(abs(r)) AS ma FROM p)
SELECT section, item, segment, stat, round(value, 6) AS value FROM (
{_long_rows("d", "eda_items", "var", "'TOTAL'", {k: k for k in ("n", "mean", "std", "min", "max")})}
UNION ALL {_long_rows("d", "eda_low", "var", "'TOTAL'", {"pct_low": "low"})}
UNION ALL {_long_rows("t", "eda_pairs", "v1 || ' / ' || v2", "'TOTAL'", {"r": "r"})}
UNION ALL {_long_rows("a", "eda_pairs", "'all'", "'TOTAL'", {"mean_r": "m", "mean_abs_r": "ma"})})""")
def report_eda(spark, sf_dir):
    """Item statistics, low shares, strongest correlations and their mean."""
    return rp.eda(line_items(spark, sf_dir), _EDA).withColumn("value", r6("value"))


# two items: the components have a closed form
_MODEL_SQL = f"""WITH {embed_points_sql(2)},
cv AS (SELECT covar_samp(x0, x0) AS a, covar_samp(x0, x1) AS b, covar_samp(x1, x1) AS d, avg(x0) AS m0, avg(x1) AS m1 FROM pts),
ev AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS l1 FROM cv),
v AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS u0, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS u1 FROM ev),
sg AS (SELECT *, CASE WHEN (CASE WHEN abs(u0) >= abs(u1) THEN u0 ELSE u1 END) < 0 THEN -1 ELSE 1 END AS s FROM v),
c2 AS (SELECT *, s * u0 AS a0, s * u1 AS a1, -s * u1 AS b0, s * u0 AS b1 FROM sg),
c3 AS (SELECT *, CASE WHEN (CASE WHEN abs(b0) >= abs(b1) THEN b0 ELSE b1 END) < 0 THEN -1 ELSE 1 END AS t FROM c2),
comp AS (SELECT 'pc1' AS item, 100 * l1 / (a + d) AS pct, 100 * l1 / (a + d) AS cum, 50.0E0 AS kaiser FROM ev
         UNION ALL SELECT 'pc2', 100 - 100 * l1 / (a + d), 100.0E0, 50.0E0 FROM ev),
tgt AS (SELECT CASE WHEN 100 * l1 / (a + d) >= 85 THEN 1 ELSE 2 END AS k FROM ev),
pr AS (SELECT label AS seg, count(*) AS n, avg(a0 * (x0 - m0) + a1 * (x1 - m1)) AS pc1,
              avg(t * (b0 * (x0 - m0) + b1 * (x1 - m1))) AS pc2 FROM pts, c3 GROUP BY label),
m AS (SELECT label AS seg, unnest(['x0', 'x1']) AS var, unnest([avg(x0), avg(x1)]) AS mean FROM pts GROUP BY label),
r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY mean DESC, var) AS rt,
             row_number() OVER (PARTITION BY seg ORDER BY mean, var) AS rb FROM m)
SELECT section, item, segment, stat, round(value, 6) AS value FROM (
{_long_rows("comp", "model_pca", "item", "'TOTAL'", {"pct": "pct", "cum_pct": "cum", "kaiser_pct": "kaiser"})}
UNION ALL {_long_rows("tgt", "model_pca", "'components'", "'TOTAL'", {"n_for_target": "k"})}
UNION ALL {_long_rows("pr", "model_projection", "'label'", "CAST(seg AS VARCHAR)", {"n": "n", "pc1": "pc1", "pc2": "pc2"})}
UNION ALL {_long_rows("r", "model_strengths", "var", "CAST(seg AS VARCHAR)", {"top": "rt", "mean": "mean"})}
UNION ALL {_long_rows("r", "model_strengths", "var", "CAST(seg AS VARCHAR)", {"bottom": "rb", "mean": "mean"})})"""


@register("report_modelling", _MODEL_SQL)
def report_modelling(spark, sf_dir):
    """Components, projection of the segments, strengths, as one long table."""
    return rp.modelling(embed_points(spark, sf_dir, 2), ["x0", "x1"], "label").withColumn("value", r6("value"))
