"""Encoder queries (E1–E23, J2, J3, A10, A12, X*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import encode, profile, schema
from tessera.plans import survey_config as cfg
from tessera.plans.catalog import register, r6
from tessera.plans.proxies import SURVEY_SQL, survey
from tessera.sources.tables import load

# --- fixed values: proxy scales --------------------------------------------
_PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5}
_T1_SCALE = {"URGENT": 5, "HIGH": 4, "MEDIUM": 3, "NOT SPECIFIED": 2, "LOW": 1}
_PART_RULES = [(0, ["na"]), (1, ["red", "blue"]), (2, ["hot", "cold"]), (4, ["gear"]), (5, ["large"])]
_PART_REPLACE = {"HOT PLATE": "PLATE"}
_PART_VALID = ["RED PLATE", "SMALL WIDGET", "PLATE", "HOT RING", "OLD ROD"]
_STATUS_NAMES = {"F": "Finalizado", "O": "Abierto"}
# --------------------------------------------------------------------------


@register("dict_encode", """SELECT o_orderkey,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
                       WHEN '5-LOW' THEN 5 END AS prio_code FROM orders""")
def dict_encode(spark, sf_dir):
    """Dictionary scale, unmapped answers → null."""
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", encode.map_values("o_orderpriority", _PRIORITY).alias("prio_code"))


@register("binary_encode", f"""WITH {SURVEY_SQL}
SELECT row_id,
  CASE WHEN b1 IN ('Si', 'SI', 'si') THEN 1 WHEN b1 IN ('No', 'NO', 'no') THEN 0 END AS b1_code,
  CASE WHEN b2 IN ('Si', 'SI', 'si') THEN 1 WHEN b2 IN ('No', 'NO', 'no') THEN 0 END AS b2_code
FROM survey""")
def binary_encode(spark, sf_dir):
    """yes/no spellings → 1/0, anything else → null."""
    s = survey(spark, sf_dir)
    return s.select("row_id", encode.binary_encode("b1", cfg.YES_A, cfg.NO_A).alias("b1_code"),
                    encode.binary_encode("b2", cfg.YES_A, cfg.NO_A).alias("b2_code"))


@register("scale_by_prefix", f"""WITH {SURVEY_SQL}
SELECT row_id, CASE t1 WHEN 'URGENT' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3
                       WHEN 'NOT SPECIFIED' THEN 2 WHEN 'LOW' THEN 1 END AS t1_sat FROM survey""")
def scale_by_prefix(spark, sf_dir):
    """Column found by a truncated prefix, text scale → number."""
    s = survey(spark, sf_dir)
    col = schema.resolve_prefix(s.columns, "t1 — how satisfied are you", 2)
    return s.select("row_id", encode.map_values(col, _T1_SCALE).alias("t1_sat"))


@register("decode_binary", f"""WITH {SURVEY_SQL},
e AS (SELECT row_id, CASE WHEN b1 IN ('Si', 'SI', 'si') THEN 1 WHEN b1 IN ('No', 'NO', 'no') THEN 0 END AS c
      FROM survey)
SELECT row_id, CASE c WHEN 1 THEN 'Si' WHEN 0 THEN 'No' END AS b1_label FROM e""")
def decode_binary(spark, sf_dir):
    """Codes back to labels."""
    s = survey(spark, sf_dir)
    e = s.select("row_id", encode.binary_encode("b1", cfg.YES_A, cfg.NO_A).alias("c"))
    return e.select("row_id", encode.decode_values("c", {1: "Si", 0: "No"}).alias("b1_label"))


def _rules_sql(col: str) -> str:
    v = f"lower(regexp_replace({col}, '^[\\s ]+|[\\s ]+$', '', 'g'))"
    whens = [f"WHEN {col} IS NULL OR regexp_matches({v}, '^[0-9]+$') THEN NULL"]
    for lvl, words in _PART_RULES:
        cond = " OR ".join(f"contains({v}, '{w}')" for w in words)
        whens.append(f"WHEN {cond} THEN {lvl}")
    return f"(CASE {' '.join(whens)} ELSE 3 END)"


@register("keyword_rules", f"""SELECT p_partkey,
  CASE WHEN {_rules_sql('p_name')} <> 0 THEN {_rules_sql('p_name')} END AS level FROM part""")
def keyword_rules(spark, sf_dir):
    """Ordered keyword rules on free text, default 3, level 0 → null."""
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", encode.keyword_level("p_name", _PART_RULES, 3, null_levels=(0,)).alias("level"))


def _change_df(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    code = F.substring("o_orderpriority", 1, 1).cast("double")
    key = F.struct("o_orderdate", "o_orderkey")
    g = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min_by(code, key).alias("first_code"), F.max_by(code, key).alias("last_code"))
    return g.withColumn("change", encode.change_score("last_code", "first_code", 1, 5))


_CHANGE_SQL = """ch AS (
SELECT c_custkey, first_code, last_code,
       CASE WHEN first_code BETWEEN 1 AND 5 AND last_code BETWEEN 1 AND 5 THEN last_code - first_code END AS change
FROM (SELECT o_custkey AS c_custkey,
             max(CASE WHEN rn_a = 1 THEN code END) AS first_code,
             max(CASE WHEN rn_d = 1 THEN code END) AS last_code
      FROM (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS code,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn_a,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn_d
            FROM orders)
      GROUP BY o_custkey))"""


@register("change_score", f"""WITH {_CHANGE_SQL}
SELECT c_custkey, first_code, last_code, change,
       CASE WHEN change > 0 THEN 'Ascenso' WHEN change = 0 THEN 'Sin cambio' WHEN change < 0 THEN 'Descenso' END
         AS change_label
FROM ch""")
def change_score(spark, sf_dir):
    """Latest minus earliest priority code per customer, labelled."""
    ch = _change_df(spark, sf_dir)
    return ch.select("c_custkey", "first_code", "last_code", "change",
                     encode.sign_label("change").alias("change_label"))


@register("change_classes_rollup", f"""WITH {_CHANGE_SQL},
j AS (SELECT c.c_mktsegment, ch.change FROM ch JOIN customer c ON ch.c_custkey = c.c_custkey
      WHERE ch.change IS NOT NULL)
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n,
       round(100.0E0 * count(*) FILTER (WHERE change > 0) / count(*), 6) AS pct_up,
       round(100.0E0 * count(*) FILTER (WHERE change = 0) / count(*), 6) AS pct_same,
       round(100.0E0 * count(*) FILTER (WHERE change < 0) / count(*), 6) AS pct_down,
       CAST(grouping(c_mktsegment) AS BIGINT) AS is_total
FROM j GROUP BY ROLLUP (c_mktsegment)""")
def change_classes_rollup(spark, sf_dir):
    """up/same/down shares per segment and overall (rollup)."""
    ch = _change_df(spark, sf_dir)
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    r = profile.sign_classes(ch.join(c, "c_custkey"), "change", "c_mktsegment")
    return r.select("c_mktsegment", "n", r6("pct_up").alias("pct_up"), r6("pct_same").alias("pct_same"),
                    r6("pct_down").alias("pct_down"), F.col("is_total").cast("long").alias("is_total"))


@register("coalesce_chain", f"""WITH {SURVEY_SQL}
SELECT row_id, coalesce(q1, q2, q4) AS first_answer FROM survey""")
def coalesce_chain(spark, sf_dir):
    """First non-null of three masked answers."""
    s = survey(spark, sf_dir)
    return s.select("row_id", encode.coalesce_chain("q1", "q2", "q4").alias("first_answer"))


_NOM = ("CASE WHEN regexp_matches(regexp_replace(p_name, '^[\\s ]+|[\\s ]+$', '', 'g'), '^[0-9]+$') "
        "THEN NULL ELSE upper(regexp_replace(p_name, '^[\\s ]+|[\\s ]+$', '', 'g')) END")


@register("nominal_clean", f"""WITH c AS (SELECT p_partkey,
  CASE WHEN ({_NOM}) = 'HOT PLATE' THEN 'PLATE' ELSE ({_NOM}) END AS v FROM part)
SELECT p_partkey, CASE WHEN v IN ('RED PLATE', 'SMALL WIDGET', 'PLATE', 'HOT RING', 'OLD ROD') THEN v END
  AS name_clean FROM c""")
def nominal_clean(spark, sf_dir):
    """Digits → null, strip, upper, replace, keep valid set."""
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", encode.nominal_clean("p_name", _PART_REPLACE, _PART_VALID, upper=True)
                    .alias("name_clean"))


@register("lump_rare", """WITH c AS (SELECT p_partkey, upper(regexp_replace(p_name, '^[\\s ]+|[\\s ]+$', '', 'g')) AS v
                          FROM part),
f AS (SELECT v, count(*) AS n FROM c GROUP BY v)
SELECT p_partkey, CASE WHEN c.v IS NULL THEN NULL WHEN f.n >= 30 THEN c.v ELSE 'Otro' END AS name_lumped
FROM c LEFT JOIN f ON c.v = f.v""")
def lump_rare(spark, sf_dir):
    """Categories seen fewer than 30 times become 'Otro'."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    return encode.lump_rare(p, "p_name", 30, "Otro", out="name_lumped").select("p_partkey", "name_lumped")


@register("additive_score", f"""WITH {SURVEY_SQL},
e AS (SELECT row_id,
        CASE WHEN b1 IN ('Si', 'SI', 'si') THEN 1 WHEN b1 IN ('No', 'NO', 'no') THEN 0 END AS b1c,
        CASE WHEN b2 IN ('Si', 'SI', 'si') THEN 1 WHEN b2 IN ('No', 'NO', 'no') THEN 0 END AS b2c,
        CASE WHEN q1 IS NULL THEN NULL WHEN q1 >= 3 THEN 1 ELSE 0 END AS q1c FROM survey)
SELECT row_id, coalesce(CAST(b1c AS DOUBLE), 0.0E0) + coalesce(CAST(b2c AS DOUBLE), 0.0E0)
               + coalesce(CAST(q1c AS DOUBLE), 0.0E0) AS score FROM e""")
def additive_score(spark, sf_dir):
    """Sum of binaries, nulls count as 0."""
    s = survey(spark, sf_dir)
    e = s.select("row_id", encode.binary_encode("b1", cfg.YES_A, cfg.NO_A).alias("b1c"),
                 encode.binary_encode("b2", cfg.YES_A, cfg.NO_A).alias("b2c"),
                 F.when(F.col("q1").isNotNull(), (F.col("q1") >= 3).cast("int")).alias("q1c"))
    return e.select("row_id", encode.additive_score(["b1c", "b2c", "q1c"]).alias("score"))


@register("date_features", """SELECT o_orderkey,
  round(CASE WHEN datediff('day', CAST(o_orderdate AS DATE), DATE '2026-01-01') / 365.25E0 BETWEEN 18 AND 80
             THEN datediff('day', CAST(o_orderdate AS DATE), DATE '2026-01-01') / 365.25E0 END, 6) AS age,
  CASE WHEN year(o_orderdate) BETWEEN 1970 AND 2026 THEN year(o_orderdate) END AS yr,
  2026 - CASE WHEN year(o_orderdate) BETWEEN 1970 AND 2026 THEN year(o_orderdate) END AS years_since
FROM orders""")
def date_features(spark, sf_dir):
    """Age in years to 2026-01-01, year, years since (bounded)."""
    o = load(spark, sf_dir, "orders")
    yr = encode.year_of("o_orderdate").cast("long")
    return o.select("o_orderkey", r6(encode.age_years("o_orderdate")).alias("age"),
                    yr.alias("yr"), (F.lit(2026) - yr).alias("years_since"))


@register("name_segments", """SELECT o_orderkey,
  coalesce(CASE o_orderstatus WHEN 'F' THEN 'Finalizado' WHEN 'O' THEN 'Abierto' END,
           'Arquetipo ' || o_orderstatus) AS segment_name FROM orders""")
def name_segments(spark, sf_dir):
    """Segment code → name, default 'Arquetipo <code>'."""
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", encode.name_segments("o_orderstatus", _STATUS_NAMES).alias("segment_name"))
