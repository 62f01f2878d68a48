"""Proxy survey tables derived from the test data.

The reference works on questionnaire exports that are not published, so the
operators are exercised on survey-shaped tables that Spark derives from the
given tables.  Each proxy has an SQL twin (a CTE) used by the oracle; both
keep every row of their source tables — nulls, sentinels and bad domain
values are *injected* deterministically from the keys, never filtered on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import survey_config as cfg
from tessera.sources.tables import load


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-level survey proxy: one respondent per order.

    ``row_id, seg, site, cat_program, q1..q4 (ordinal, with nulls and the
    sentinel 87), b1, b2 (yes/no text with bad values), t1 (ordinal text with
    a "not applicable" token), sparse_col (98 % null), dt``.
    """
    o = load(spark, sf_dir, "orders")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    k = F.col("o_orderkey")
    return j.select(
        k.alias("row_id"),
        F.col("o_orderstatus").alias("seg"),
        F.col("n_name").alias("site"),
        F.col("c_mktsegment").alias("cat_program"),
        F.when(k % 7 != 0, F.substring("o_orderpriority", 1, 1).cast("double")).alias("q1"),
        F.when(k % 11 != 0, (F.floor(F.col("o_totalprice") / 100000.0) + 1).cast("double")).alias("q2"),
        F.when(k % 97 == 0, F.lit(87.0)).otherwise((F.month("o_orderdate") % 6).cast("double")).alias("q3"),
        F.when(k % 13 != 0, F.floor((F.col("c_acctbal") + 1000.0) / 2000.0).cast("double")).alias("q4"),
        F.when(k % 17 == 0, F.lit("128")).when(F.col("o_totalprice") > 250000.0, F.lit("Si"))
         .otherwise(F.lit("No")).alias("b1"),
        F.when(k % 19 == 0, F.lit(None).cast("string")).when(F.col("c_acctbal") > 4500.0, F.lit("SI"))
         .otherwise(F.lit("no")).alias("b2"),
        F.when(k % 23 == 0, F.lit("No aplica")).otherwise(F.substring("o_orderpriority", 3, 100)).alias("t1"),
        F.when(k % 50 == 0, F.lit("x")).alias("sparse_col"),
        F.col("o_orderdate").alias("dt"),
    )


SURVEY_SQL = """survey AS (
SELECT o.o_orderkey AS row_id,
       o.o_orderstatus AS seg,
       n.n_name AS site,
       c.c_mktsegment AS cat_program,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(substr(o.o_orderpriority, 1, 1) AS DOUBLE) END AS q1,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o.o_totalprice / 100000E0) + 1 AS DOUBLE) END AS q2,
       CASE WHEN o.o_orderkey % 97 = 0 THEN 87E0 ELSE CAST(month(o.o_orderdate) % 6 AS DOUBLE) END AS q3,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor((c.c_acctbal + 1000E0) / 2000E0) AS DOUBLE) END AS q4,
       CASE WHEN o.o_orderkey % 17 = 0 THEN '128' WHEN o.o_totalprice > 250000E0 THEN 'Si' ELSE 'No' END AS b1,
       CASE WHEN o.o_orderkey % 19 = 0 THEN NULL WHEN c.c_acctbal > 4500E0 THEN 'SI' ELSE 'no' END AS b2,
       CASE WHEN o.o_orderkey % 23 = 0 THEN 'No aplica' ELSE substr(o.o_orderpriority, 3) END AS t1,
       CASE WHEN o.o_orderkey % 50 = 0 THEN 'x' END AS sparse_col,
       o.o_orderdate AS dt
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

SURVEY_ITEMS = ["q1", "q2", "q3", "q4"]


def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated numeric block from documents: chars, words, lines."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.col("lang").alias("seg"),
        F.col("source"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.trim(F.col("text")), r"\s+")).cast("double").alias("n_words"),
        (F.size(F.split(F.col("text"), "\n"))).cast("double").alias("n_lines"),
    )


DOC_METRICS_SQL = r"""docm AS (
SELECT doc_id AS row_id, lang AS seg, source,
       CAST(n_chars AS DOUBLE) AS n_chars,
       CAST(len(regexp_split_to_array(trim(text), '\s+')) AS DOUBLE) AS n_words,
       CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines
FROM documents)"""

DOC_COLS = ["n_chars", "n_words", "n_lines"]


#: Length of the vectors in ``embeddings``.
EMBED_DIMS = 64


def embed_points(spark: SparkSession, sf_dir: str, dims: int = 3) -> DataFrame:
    """``embeddings`` as points: coordinate j is the sum of the vector's entries
    j, j + dims, j + 2·dims, .. (all 64 entries are used), plus the label."""
    e = load(spark, sf_dir, "embeddings")
    def coordinate(j):
        total = F.lit(0.0)
        for i in range(j, EMBED_DIMS, dims):
            total = total + F.col("embedding")[i].cast("double")
        return total
    return e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("label"),
                    *[coordinate(j).alias(f"x{j}") for j in range(dims)])


def embed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as 64 columns ``x0..x63`` with the row id."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"),
                    *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(EMBED_DIMS)])


def embed_points_sql(dims: int = 3) -> str:
    def coordinate(j):
        return "0.0E0 + " + " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(j, EMBED_DIMS, dims))
    cols = ", ".join(f"{coordinate(j)} AS x{j}" for j in range(dims))
    return f"pts AS MATERIALIZED (SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label, {cols} FROM embeddings)"


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem measures with returnflag as the segment."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("seg"), "l_quantity", "l_discount", "l_tax",
                     "l_extendedprice", "l_linestatus")


# Table B: every answer column cycles through the answers of one of the study's
# scales; two more answers stand for a gap and for a value outside the scale.
_B_ANSWERS = {
    "logro_1": list(cfg.ATTAINMENT_SCALE) + [cfg.NOT_APPLICABLE], "logro_2": list(cfg.ATTAINMENT_SCALE) + [cfg.NOT_APPLICABLE],
    "incidencia": list(cfg.INCIDENCE_SCALE) + [cfg.NOT_APPLICABLE], "cargo": list(cfg.JOB_TYPE_SCALE),
    "contrato": list(cfg.CONTRACT_SCALE), "acuerdo": list(cfg.AGREEMENT_SCALE),
    "suficiencia": list(cfg.SUFFICIENCY_SCALE), "nivel": list(cfg.EDUCATION_LEVEL_SCALE),
    "ingreso": list(cfg.INCOME_SCALE), "primer_empleo": list(cfg.FIRST_JOB_SCALE), "sector": list(cfg.SECTOR_SCALE),
    "satisfaccion": list(cfg.SATISFACTION_SCALE), "padres": list(cfg.PARENTS_EDUCATION),
    "salario_1": list(cfg.SALARY_UNDERGRAD), "salario_2": list(cfg.SALARY_SPECIALISATION),
    "salario_3": list(cfg.SALARY_MASTERS), "genero": cfg.VALID_CATEGORIES["cat_genero"],
    "laborando": ["Si", "No", "SI", "NO"],
}
#: Code tables of the answer columns.
B_SCALES = {
    "logro_1": cfg.ATTAINMENT_SCALE, "logro_2": cfg.ATTAINMENT_SCALE, "incidencia": cfg.INCIDENCE_SCALE,
    "cargo": cfg.JOB_TYPE_SCALE, "contrato": cfg.CONTRACT_SCALE, "acuerdo": cfg.AGREEMENT_SCALE,
    "suficiencia": cfg.SUFFICIENCY_SCALE, "nivel": cfg.EDUCATION_LEVEL_SCALE, "ingreso": cfg.INCOME_SCALE,
    "primer_empleo": cfg.FIRST_JOB_SCALE, "sector": cfg.SECTOR_SCALE, "satisfaccion": cfg.SATISFACTION_SCALE,
}
B_SALARY = [("salario_1", cfg.SALARY_UNDERGRAD), ("salario_2", cfg.SALARY_SPECIALISATION),
            ("salario_3", cfg.SALARY_MASTERS)]


def _b_step(i: int) -> tuple[int, int]:
    """How the i-th column's answer follows from the order key."""
    return 2 * i + 3, i


def survey_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-level proxy of table B: ``row_id, seg, cedula`` (repeated key),
    ``consentimiento`` (personal), one text column per scale, ``vacia`` (95 % null)."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cols = []
    for i, (c, answers) in enumerate(_B_ANSWERS.items()):
        a, b = _b_step(i)
        every = F.array(*[F.lit(x) for x in [*answers, "otro valor"]], F.lit(None).cast("string"))
        cols.append(every[((k * a + F.floor(k / 4) + b) % (len(answers) + 2)).cast("int")].alias(c))
    return o.select(k.alias("row_id"), F.col("o_orderstatus").alias("seg"),
                    F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.substring("o_orderpriority", 1, 1)).alias("cedula"),
                    F.lit("acepto").alias("consentimiento"), *cols,
                    F.when(k % 20 == 0, F.lit("x")).alias("vacia"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def survey_b_sql() -> str:
    cols = []
    for i, (c, answers) in enumerate(_B_ANSWERS.items()):
        a, b = _b_step(i)
        every = ", ".join([*map(_sql_text, [*answers, "otro valor"]), "NULL"])
        cols.append(f"([{every}])[(o_orderkey * {a} + o_orderkey // 4 + {b}) % {len(answers) + 2} + 1] AS {c}")
    return f"""survey_b AS (SELECT o_orderkey AS row_id, o_orderstatus AS seg,
  CAST(o_custkey AS VARCHAR) || '-' || substr(o_orderpriority, 1, 1) AS cedula, {', '.join(cols)},
  CASE WHEN o_orderkey % 20 = 0 THEN 'x' END AS vacia FROM orders)"""


def scale_sql(col: str, scale: dict) -> str:
    """CASE expression of a code table."""
    return "CASE " + col + " " + " ".join(f"WHEN {_sql_text(t)} THEN {v if not isinstance(v, str) else _sql_text(v)}"
                                          for t, v in scale.items()) + " END"


B_COLUMNS = list(_B_ANSWERS)
