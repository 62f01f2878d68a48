"""End-to-end flow queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import encode, profile, quality, ranks
from tessera.operators import report as rp
from tessera.plans import flows
from tessera.plans.catalog import ORACLE, register, r6, sql_long
from tessera.plans.proxies import SURVEY_SQL, embed_points, line_items, survey
from tessera.session import scratch_path
from tessera.sources import stage
from tessera.sources.scratch import saved
from tessera.sources.tables import read_source

_QUESTIONS = ["seg", "site", "cat_program", "q1", "q2", "q3", "q4", "b1", "b2", "t1", "sparse_col", "dt"]
_SPEC = flows.IngestSpec(question_cols=_QUESTIONS, pii_cols=["contact"], sentinel_col="q3",
                         likert_cols=["q1", "q2", "q3"], binary_cols=["b1", "b2"], stratum_cols=["q4"])


def _raw(spark, sf_dir):
    s = survey(spark, sf_dir)
    return s.withColumn("contact", F.concat(F.lit("user"), F.col("row_id").cast("string")))


def _clean(spark, sf_dir):
    return flows.ingest(_raw(spark, sf_dir), _SPEC)


_ALLNULL = " AND ".join(f"{c} IS NULL" for c in _QUESTIONS)
_KEEP = ["seg", "site", "cat_program", "q1", "q2", "q3", "q4", "b1", "b2", "t1", "dt"]
_INC = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _KEEP)
_INGEST_CTE = f"""{SURVEY_SQL},
f AS (SELECT * FROM survey WHERE NOT ({_ALLNULL}) AND q3 IS DISTINCT FROM 87E0),
d AS (SELECT min(row_id) AS row_id, seg, site, cat_program, q1, q2, q3, q4, b1, b2, t1, sparse_col, dt
      FROM f GROUP BY seg, site, cat_program, q1, q2, q3, q4, b1, b2, t1, sparse_col, dt),
i AS (SELECT * FROM d WHERE ({_INC}) / {float(len(_KEEP))}E0 <= 0.9E0),
clean AS (SELECT row_id, seg, site, cat_program,
                 CASE WHEN q1 BETWEEN 1 AND 5 THEN q1 END AS q1, CASE WHEN q2 BETWEEN 1 AND 5 THEN q2 END AS q2,
                 CASE WHEN q3 BETWEEN 1 AND 5 THEN q3 END AS q3, CASE WHEN q4 BETWEEN 1 AND 6 THEN q4 END AS q4,
                 CASE WHEN b1 IN ('Si', 'No') THEN b1 END AS b1, CASE WHEN b2 IN ('Si', 'No') THEN b2 END AS b2,
                 t1, CAST(dt AS VARCHAR) AS dt FROM i)"""


@register("ingest_flow", f"WITH {_INGEST_CTE}\nSELECT * FROM clean")
def ingest_flow(spark, sf_dir):
    """PII → empty rows → sentinel → duplicates → sparse columns → incomplete rows → validation."""
    clean, _ = _clean(spark, sf_dir)
    return clean.select(*[F.col(c).cast("string").alias(c) if c == "dt" else F.col(c)
                          for c in ["row_id", *_KEEP]])


@register("quality_report", f"""WITH {SURVEY_SQL},
a AS (SELECT count(*) AS n_raw, count(*) FILTER (WHERE {_ALLNULL}) AS n_empty,
             count(*) FILTER (WHERE NOT ({_ALLNULL}) AND q3 IS NOT DISTINCT FROM 87E0) AS n_sent FROM survey),
f AS (SELECT * FROM survey WHERE NOT ({_ALLNULL}) AND q3 IS DISTINCT FROM 87E0),
d AS (SELECT min(row_id) AS row_id, seg, site, cat_program, q1, q2, q3, q4, b1, b2, t1, sparse_col, dt
      FROM f GROUP BY seg, site, cat_program, q1, q2, q3, q4, b1, b2, t1, sparse_col, dt),
sp AS (SELECT CAST(avg(CAST(sparse_col IS NULL AS INTEGER)) > 0.95 AS INTEGER) AS n_sparse FROM d),
i AS (SELECT *, ({_INC}) / {float(len(_KEEP))}E0 > 0.9E0 AS inc FROM d),
b AS (SELECT count(*) FILTER (WHERE inc) AS n_inc,
             sum(CASE WHEN NOT inc THEN {' + '.join(f'CAST({c} IS NOT NULL AND NOT ({c} BETWEEN 1 AND 5) AS INTEGER)' for c in ['q1', 'q2', 'q3'])} END) AS n_lik,
             sum(CASE WHEN NOT inc THEN {' + '.join(f"CAST({c} IS NOT NULL AND {c} NOT IN ('Si', 'No') AS INTEGER)" for c in ['b1', 'b2'])} END) AS n_bin,
             sum(CASE WHEN NOT inc THEN CAST(q4 IS NOT NULL AND NOT (q4 BETWEEN 1 AND 6) AS INTEGER) END) AS n_str,
             count(*) AS n_dedup FROM i)
SELECT CAST(n_raw AS BIGINT) AS n_rows_raw, CAST(14 AS BIGINT) AS n_cols_raw, CAST(1 AS BIGINT) AS n_pii_dropped,
       CAST(n_empty AS BIGINT) AS n_empty_rows, CAST(n_sent AS BIGINT) AS n_sentinel_rows,
       CAST(n_raw - n_empty - n_sent - n_dedup AS BIGINT) AS n_duplicates, CAST(n_sparse AS BIGINT) AS n_sparse_cols,
       CAST(n_inc AS BIGINT) AS n_incomplete_rows, CAST(n_lik AS BIGINT) AS n_likert_invalid,
       CAST(n_bin AS BIGINT) AS n_binary_invalid, CAST(n_str AS BIGINT) AS n_stratum_invalid,
       CAST(n_dedup - n_inc AS BIGINT) AS n_rows_final, CAST(14 - 1 - n_sparse AS BIGINT) AS n_cols_final
FROM a, sp, b""")
def quality_report(spark, sf_dir):
    """Counts of every ingest step in one row."""
    _, rep = _clean(spark, sf_dir)
    return rep


# --- fixed values: proxy feature configuration -----------------------------
_T1 = {"URGENT": 5, "HIGH": 4, "MEDIUM": 3, "NOT SPECIFIED": 2, "LOW": 1}
_SITE_RULES = [(1, ["united"]), (2, ["china", "japan", "india"]), (4, ["an"])]
# --------------------------------------------------------------------------
_FSPEC = flows.FeatureSpec(
    rename={"t1": "sat_t1"},
    binary={"b1": (["Si"], ["No"]), "b2": (["Si"], ["No"])},
    scales={"sat_t1": _T1},
    change=("mobility", "q2", "q1", 1, 5),
    keyword=("site_level", "site", _SITE_RULES, 3, ()),
    scores={"wellbeing": ["b1", "b2"], "effort": ["q1", "q2", "q3"]},
    nominal={"programme": ("cat_program", {"HOUSEHOLD": "HOME"},
                           ["AUTOMOBILE", "BUILDING", "HOME", "MACHINERY"], True)},
    lumps=[("site", 600, "Otro")])


def _features(spark, sf_dir):
    clean, _ = _clean(spark, sf_dir)
    return flows.features(clean, _FSPEC)


_SITE_V = "lower(regexp_replace(site, '^[\\s ]+|[\\s ]+$', '', 'g'))"
_FEAT_CTE = f"""{_INGEST_CTE},
e AS (SELECT row_id, seg, cat_program, q1, q2, q3, q4, site,
             CASE b1 WHEN 'Si' THEN 1 WHEN 'No' THEN 0 END AS b1, CASE b2 WHEN 'Si' THEN 1 WHEN 'No' THEN 0 END AS b2,
             CASE t1 WHEN 'URGENT' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'NOT SPECIFIED' THEN 2
                     WHEN 'LOW' THEN 1 END AS sat_t1,
             CASE WHEN q2 BETWEEN 1 AND 5 AND q1 BETWEEN 1 AND 5 THEN q2 - q1 END AS mobility,
             CASE WHEN site IS NULL OR regexp_matches({_SITE_V}, '^[0-9]+$') THEN NULL
                  WHEN contains({_SITE_V}, 'united') THEN 1
                  WHEN contains({_SITE_V}, 'china') OR contains({_SITE_V}, 'japan') OR contains({_SITE_V}, 'india') THEN 2
                  WHEN contains({_SITE_V}, 'an') THEN 4 ELSE 3 END AS site_level FROM clean),
e2 AS (SELECT *, coalesce(CAST(b1 AS DOUBLE), 0.0E0) + coalesce(CAST(b2 AS DOUBLE), 0.0E0) AS wellbeing,
              coalesce(q1, 0.0E0) + coalesce(q2, 0.0E0) + coalesce(q3, 0.0E0) AS effort,
              CASE WHEN cat_program = 'HOUSEHOLD' THEN 'HOME'
                   WHEN cat_program IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN cat_program END AS programme,
              upper(regexp_replace(site, '^[\\s ]+|[\\s ]+$', '', 'g')) AS sv FROM e),
fr AS (SELECT sv, count(*) AS n FROM e2 WHERE sv IS NOT NULL GROUP BY sv),
feat AS (SELECT e2.* EXCLUDE (site, sv),
                CASE WHEN e2.sv IS NULL THEN NULL WHEN fr.n >= 600 THEN e2.sv ELSE 'Otro' END AS site
         FROM e2 LEFT JOIN fr ON e2.sv = fr.sv)"""

_FEAT_COLS = ["row_id", "seg", "cat_program", "q1", "q2", "q3", "q4", "b1", "b2", "sat_t1", "mobility",
              "site_level", "wellbeing", "effort", "programme", "site"]


@register("features_flow", f"WITH {_FEAT_CTE}\nSELECT {', '.join(_FEAT_COLS)} FROM feat")
def features_flow(spark, sf_dir):
    """Rename → binaries → scale → change score → keyword rules → additive score → rare lumping."""
    f = _features(spark, sf_dir)
    return f.select(*[F.col(c).cast("int").alias(c) if c in ("b1", "b2", "sat_t1", "site_level") else F.col(c)
                      for c in _FEAT_COLS])


_REPORT_SQL = f"""WITH {_FEAT_CTE},
dist AS (SELECT 'distribution' AS section, seg AS k1, '' AS k2, CAST(count(*) AS DOUBLE) AS n,
                100.0E0 * count(*) / sum(count(*)) OVER () AS value FROM feat GROUP BY seg),
lg AS ({sql_long("feat", ["q1", "q2", "q3", "q4", "wellbeing"], ["seg"])}),
means AS (SELECT 'means' AS section, var AS k1, seg AS k2, CAST(count(*) AS DOUBLE) AS n, avg(val) AS value
          FROM lg WHERE seg IS NOT NULL GROUP BY var, seg),
mob AS (SELECT 'mobility_up' AS section, coalesce(seg, 'TOTAL') AS k1, '' AS k2, CAST(count(*) AS DOUBLE) AS n,
               100.0E0 * count(*) FILTER (WHERE mobility > 0) / count(*) AS value
        FROM feat WHERE mobility IS NOT NULL GROUP BY ROLLUP (seg)),
ct AS (SELECT 'site_by_seg' AS section, seg AS k1, site AS k2, CAST(count(*) AS DOUBLE) AS n,
              100.0E0 * count(*) / sum(count(*)) OVER (PARTITION BY seg) AS value
       FROM feat WHERE seg IS NOT NULL AND site IS NOT NULL GROUP BY seg, site)
SELECT section, k1, k2, n, round(value, 6) AS value FROM (
  SELECT * FROM dist UNION ALL SELECT * FROM means UNION ALL SELECT * FROM mob UNION ALL SELECT * FROM ct)"""


@register("report_flow", _REPORT_SQL)
def report_flow(spark, sf_dir):
    """R22 (R3, R4, R11, R12): distribution, item means, mobility, category profile per segment."""
    f = saved(_features(spark, sf_dir), "features")
    dist = profile.freq_share(f, "seg").select(F.lit("distribution").alias("section"), F.col("value").alias("k1"),
                                                F.lit("").alias("k2"), F.col("n").cast("double").alias("n"),
                                                (100.0 * F.col("share")).alias("value"))
    means = profile.grouped_means(f, ["q1", "q2", "q3", "q4", "wellbeing"], "seg").select(
        F.lit("means").alias("section"), F.col("var").alias("k1"), F.col("seg").alias("k2"),
        F.col("n").cast("double").alias("n"), F.col("mean").alias("value"))
    mob = profile.sign_classes(f, "mobility", "seg").select(
        F.lit("mobility_up").alias("section"), F.when(F.col("is_total") == 1, F.lit("TOTAL"))
        .otherwise(F.col("seg")).alias("k1"), F.lit("").alias("k2"), F.col("n").cast("double").alias("n"),
        F.col("pct_up").alias("value"))
    ct = profile.crosstab_row_pct(f, "seg", "site").select(
        F.lit("site_by_seg").alias("section"), F.col("seg").alias("k1"), F.col("site").alias("k2"),
        F.col("n").cast("double").alias("n"), F.col("pct").alias("value"))
    out = dist.unionByName(means).unionByName(mob).unionByName(ct)
    return out.select("section", "k1", "k2", "n", r6("value").alias("value"))


@register("variables_summary", f"""WITH {_FEAT_CTE},
lg AS ({sql_long("feat", ["q1", "q2", "q3", "q4", "mobility", "wellbeing", "sat_t1"])})
SELECT 'stats' AS section, var AS name, CAST(count(*) AS BIGINT) AS n, round(avg(val), 2) AS mean,
       round(stddev_samp(val), 2) AS std, min(val) AS min, max(val) AS max FROM lg GROUP BY var
UNION ALL
SELECT 'cardinality', 'site', CAST(count(DISTINCT site) AS BIGINT),
       round(100.0E0 * count(*) FILTER (WHERE site IS NULL) / count(*), 2), NULL, NULL, NULL FROM feat
UNION ALL
SELECT 'cardinality', 'cat_program', CAST(count(DISTINCT cat_program) AS BIGINT),
       round(100.0E0 * count(*) FILTER (WHERE cat_program IS NULL) / count(*), 2), NULL, NULL, NULL FROM feat""")
def variables_summary(spark, sf_dir):
    """R2: stats of built variables (rounded 2) and cardinality + null % of categories."""
    f = _features(spark, sf_dir)
    st = profile.describe_many(f, ["q1", "q2", "q3", "q4", "mobility", "wellbeing", "sat_t1"]).select(
        F.lit("stats").alias("section"), F.col("var").alias("name"), "n", F.round("mean", 2).alias("mean"),
        F.round("std", 2).alias("std"), "min", "max")
    nulls = quality.null_fractions(f, ["site", "cat_program"])
    card = quality.distinct_profile(f, ["site", "cat_program"]).join(nulls, "column_name").select(
        F.lit("cardinality").alias("section"), F.col("column_name").alias("name"), F.col("n_distinct").alias("n"),
        F.round(100.0 * F.col("null_frac"), 2).alias("mean"), F.lit(None).cast("double").alias("std"),
        F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    return st.unionByName(card)


@register("compare_profiles", f"""WITH {SURVEY_SQL},
a AS (SELECT seg, avg(CASE WHEN q1 BETWEEN 1 AND 5 THEN q1 END) AS m FROM survey GROUP BY seg),
ar AS (SELECT seg AS seg_a, round(m, 6) AS mean_a, row_number() OVER (ORDER BY m, seg) AS rk FROM a),
b AS (SELECT l_returnflag AS seg, avg(l_quantity) AS m FROM lineitem GROUP BY l_returnflag),
br AS (SELECT seg AS seg_b, round(m, 6) AS mean_b, row_number() OVER (ORDER BY m, seg) AS rk FROM b)
SELECT CAST(coalesce(ar.rk, br.rk) AS BIGINT) AS rk, seg_a, mean_a, seg_b, mean_b
FROM ar FULL OUTER JOIN br ON ar.rk = br.rk""")
def compare_profiles(spark, sf_dir):
    """Two studies' segment profiles side by side on a segment-rank key (full outer join)."""
    s = quality.range_validate(survey(spark, sf_dir), ["q1"], 1, 5)
    j = rp.compare_studies(s, line_items(spark, sf_dir), "q1", "l_quantity", "seg", "seg")
    return j.select("rk", "seg_a", r6("mean_a").alias("mean_a"), "seg_b", r6("mean_b").alias("mean_b"))


@register("stage_roundtrip", f"""WITH {SURVEY_SQL}
SELECT row_id, seg, q1, b1, CAST(q2 AS VARCHAR) AS q2_text FROM survey""")
def stage_roundtrip(spark, sf_dir):
    """Parquet stage sink (text columns as string) and CSV sink, read back by id.

    Written under the session's checkpoint folder, to a new path each run
    (a stage never overwrites what it reads).
    """
    s = survey(spark, sf_dir)
    base = scratch_path(spark, f"stage-{uuid.uuid4().hex}")
    pq = stage.write_stage(s.select("row_id", "seg", "q1", "b1"), f"{base}/interim")
    cs = stage.write_csv(s.select("row_id", F.col("q2").cast("string").alias("q2_text")), f"{base}/csv")
    a = read_source(spark, pq, "parquet")
    b = read_source(spark, cs, "csv", schema="row_id long, q2_text string")
    return a.join(b, "row_id")


_BLOCKS = {"B1": (["q1", "q2", "q3"], 1), "B2": (["q4", "wellbeing", "sat_t1"], 1)}
_NAMES = {0: "Base", 1: "Intermedio", 2: "Alto"}


def _segmentation(spark, sf_dir):
    f = saved(_features(spark, sf_dir), "features")
    return f, flows.segment_respondents(f, _BLOCKS, ["cat_program", "site"], "row_id", names=_NAMES,
                                        score_col="wellbeing")


@register("segment_flow")
def segment_flow(spark, sf_dir):
    """Factors + MCA → latent space → k-means, Ward, DBSCAN sweeps → best and second k →
    relabel by well-being → names → sinks; the assignments of the written result."""
    f, result = _segmentation(spark, sf_dir)
    path = flows.save_segmentation(result, f, scratch_path(spark, f"segmentation-{uuid.uuid4().hex}"))
    done = spark.read.parquet(f"{path}/segmented").select("row_id", "segment", "segment_name")
    return flows.partitions(result.rows.join(done.hint("merge"), "row_id")).select(
        "row_id", "method", "choice", "k", "cluster", "name", "segment", "segment_name")


@register("segment_robustness")
def segment_robustness(spark, sf_dir):
    """Agreement of the best k-means and Ward labelings of the flow."""
    _, result = _segmentation(spark, sf_dir)
    best = result.assignments.where("choice = 'best'")
    wide = best.groupBy("row_id").pivot("method", ["kmeans", "ward"]).agg(F.first("cluster"))
    return rp.robustness(wide, "kmeans", "ward")


@register("score_new_rows", f"""WITH {_INGEST_CTE}
SELECT choice, count(*) AS n_rows, count(*) AS n_same FROM clean, (VALUES ('best'), ('second')) c(choice) GROUP BY choice""")
def score_new_rows(spark, sf_dir):
    """The saved segmentation scores rows it has not seen (the answers of all
    respondents under new ids): each falls into the k-means segment of its answers."""
    f, result = _segmentation(spark, sf_dir)
    path = flows.save_segmentation(result, f, scratch_path(spark, f"segmentation-{uuid.uuid4().hex}"), sweep=False)
    # written: what takes it apart would compute it again
    scored = saved(flows.score_rows(f.withColumn("row_id", -1 - F.col("row_id")), path), "scored")
    kmeans = F.filter("partitions", lambda p: p["method"] == "kmeans")
    own = result.rows.select("row_id", kmeans.alias("own"))
    # a row's partitions meet before they are taken apart
    both = scored.select((-1 - F.col("row_id")).alias("row_id"), kmeans.alias("scored")).join(own.hint("merge"), "row_id")
    pairs = both.select(F.explode("scored").alias("s"), "own").select("s", F.explode("own").alias("o")).where("s.choice = o.choice")
    return pairs.groupBy("s.choice").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.count_if(F.expr("s.cluster = o.cluster and s.name = o.name")).alias("n_same"))


@register("enrich_by_id", f"""WITH {_INGEST_CTE}
SELECT c.row_id, c.seg,
       round(CASE WHEN datediff('day', CAST(o.o_orderdate AS DATE), DATE '2026-01-01') / 365.25E0 BETWEEN 18 AND 80
                  THEN datediff('day', CAST(o.o_orderdate AS DATE), DATE '2026-01-01') / 365.25E0 END, 6) AS age,
       o.o_orderpriority AS priority
FROM clean c LEFT JOIN orders o ON c.row_id = o.o_orderkey""")
def enrich_by_id(spark, sf_dir):
    """A second scan of the source enriches the cleaned table by id (left join)."""
    from tessera.operators import schema
    from tessera.sources.tables import load
    clean, _ = _clean(spark, sf_dir)
    src = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        r6(encode.age_years("o_orderdate")).alias("age"), F.col("o_orderpriority").alias("priority"))
    return schema.align(clean.select("row_id", "seg"), src, "row_id", "left")


@register("shape_report", f"""WITH {_INGEST_CTE}
SELECT CAST((SELECT count(*) FROM survey) AS BIGINT) AS n_rows_before, CAST(14 AS BIGINT) AS n_cols_before,
       CAST((SELECT count(*) FROM clean) AS BIGINT) AS n_rows_after, CAST(12 AS BIGINT) AS n_cols_after,
       CAST((SELECT count(*) FROM survey) - (SELECT count(*) FROM clean) AS BIGINT) AS n_rows_removed""")
def shape_report(spark, sf_dir):
    """P10: rows × columns before and after the ingest stage, rows removed."""
    from tessera.operators import schema
    raw = _raw(spark, sf_dir)
    clean, _ = _clean(spark, sf_dir)
    rb, cb = schema.shape(raw)
    ra, ca = schema.shape(clean)
    return spark.createDataFrame([(rb, cb, ra, ca, rb - ra)],
                                 "n_rows_before long, n_cols_before long, n_rows_after long, n_cols_after long, "
                                 "n_rows_removed long")


@register("save_load_params", f"""WITH {SURVEY_SQL}
SELECT row_id, coalesce(q1, (SELECT quantile_cont(q1, 0.5) FROM survey)) AS q1,
       coalesce(q2, (SELECT quantile_cont(q2, 0.5) FROM survey)) AS q2 FROM survey""")
def save_load_params(spark, sf_dir):
    """Fitted parameters (column medians) saved as a Parquet table, loaded back and applied."""
    from tessera.operators import latent
    s = survey(spark, sf_dir).select("row_id", "q1", "q2")
    med = ranks.exact_median(s, ["q1", "q2"])
    path = scratch_path(spark, f"params-{uuid.uuid4().hex}")
    stage.save_params(spark, {"medians": med}, path)
    loaded = stage.load_params(spark, path, ["medians"])["medians"]
    fitted = {r["var"]: r["median"] for r in loaded.collect()}
    return latent.median_impute(s, ["q1", "q2"], fitted)


@register("save_load_models", ORACLE["pca_scores"])
def save_load_models(spark, sf_dir):
    """A fitted PCA saved as a Parquet table, loaded back and applied."""
    from tessera.operators import latent
    p = embed_points(spark, sf_dir, 2)
    path = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    stage.save_params(spark, {"pca": latent.fit_pca(p, ["x0", "x1"], 1).to_table(spark)}, path)
    m = latent.PCAModel.from_table(stage.load_params(spark, path, ["pca"])["pca"], ["x0", "x1"])
    return p.select("row_id", *[r6(c).alias("pc1") for c in m.score_columns()])


@register("stage_add_column", f"""WITH {SURVEY_SQL}
SELECT row_id, seg, q1, CASE WHEN q1 BETWEEN 1 AND 5 THEN q1 * 20 END AS q1_pct FROM survey""")
def stage_add_column(spark, sf_dir):
    """A stage is read, gets a column and is written again to a new path."""
    base = scratch_path(spark, f"stages-{uuid.uuid4().hex}")
    first = stage.write_stage(survey(spark, sf_dir).select("row_id", "seg", "q1"), f"{base}/1")
    again = read_source(spark, first, "parquet").withColumn("q1_pct", quality.in_range("q1", 1, 5) * 20)
    return read_source(spark, stage.write_stage(again, f"{base}/2"), "parquet")
