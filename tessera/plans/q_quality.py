"""Quality, duplicate and schema queries (P*, F*, D*, A1, A2, J1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import quality, schema
from tessera.plans.catalog import register, r6
from tessera.plans.proxies import SURVEY_ITEMS, SURVEY_SQL, survey
from tessera.sources.tables import load

_PROFILE_COLS = ["seg", "site", "cat_program", "q1", "q2", "q3", "q4", "b1", "b2", "t1", "sparse_col"]


def _null_sql(cols, src="survey"):
    parts = [f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null, "
             f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS null_frac FROM {src}" for c in cols]
    return "\nUNION ALL ".join(parts)


@register("null_profile", f"WITH {SURVEY_SQL}\n{_null_sql(_PROFILE_COLS)}")
def null_profile(spark, sf_dir):
    """A1: null count and fraction of every survey column in one scan."""
    s = survey(spark, sf_dir)
    return quality.null_fractions(s, _PROFILE_COLS).select("column_name", "n_null", r6("null_frac").alias("null_frac"))


@register("drop_sparse_columns", f"""WITH {SURVEY_SQL}, p AS ({_null_sql(_PROFILE_COLS)})
SELECT column_name, null_frac, null_frac > 0.95E0 AS dropped FROM p""")
def drop_sparse_columns(spark, sf_dir):
    """Which columns a 95 % null threshold drops (strictly greater)."""
    s = survey(spark, sf_dir).select(*_PROFILE_COLS)
    prof = quality.null_fractions(s)
    _, dropped = quality.drop_sparse_columns(s, 0.95, protect=())
    return prof.select("column_name", r6("null_frac").alias("null_frac"),
                       F.col("column_name").isin(*dropped).alias("dropped"))


_QCOLS = ["q1", "q2", "q4", "b2"]


@register("drop_empty_rows", f"""WITH {SURVEY_SQL}
SELECT row_id, q1, q2, q4, b2 FROM survey
WHERE NOT (q1 IS NULL AND q2 IS NULL AND q4 IS NULL AND b2 IS NULL)""")
def drop_empty_rows(spark, sf_dir):
    """drop rows whose answers are all null (row_id excluded from the test)."""
    s = survey(spark, sf_dir).select("row_id", *_QCOLS)
    return quality.drop_empty_rows(s, _QCOLS)


_INC = ["q1", "q2", "q4", "b2", "sparse_col"]


@register("drop_incomplete_rows", f"""WITH {SURVEY_SQL},
f AS (SELECT row_id, ({' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in _INC)}) / {float(len(_INC))}E0 AS null_share
      FROM survey)
SELECT row_id, round(null_share, 6) AS null_share FROM f WHERE null_share <= 0.7E0""")
def drop_incomplete_rows(spark, sf_dir):
    """Drop rows with a null share above 0.7 over the answer columns."""
    s = survey(spark, sf_dir)
    kept = quality.drop_incomplete_rows(s, _INC, 0.7)
    return kept.select("row_id", r6(quality.row_null_fraction(_INC)).alias("null_share"))


@register("drop_sentinel_row", f"""WITH {SURVEY_SQL}
SELECT row_id, q3 FROM survey WHERE q3 IS DISTINCT FROM 87E0""")
def drop_sentinel_row(spark, sf_dir):
    """drop the sentinel answer 87; rows with a null there stay (S-1)."""
    s = survey(spark, sf_dir).select("row_id", "q3")
    return quality.drop_sentinel_rows(s, "q3", 87)


@register("range_validate", f"""WITH {SURVEY_SQL}
SELECT row_id, {', '.join(f'CASE WHEN {c} BETWEEN 1 AND 5 THEN {c} END AS {c}' for c in SURVEY_ITEMS)}
FROM survey""")
def range_validate(spark, sf_dir):
    """coerce the Likert items and null everything outside [1, 5]."""
    s = survey(spark, sf_dir).select("row_id", *SURVEY_ITEMS)
    return quality.range_validate(s, SURVEY_ITEMS, 1, 5)


def _issues_sql(cols, cond, check="range"):
    parts = [f"SELECT '{check}' AS \"check\", '{c}' AS column_name, CAST({c} AS VARCHAR) AS bad_value, "
             f"CAST(count(*) AS BIGINT) AS n_invalid FROM survey "
             f"WHERE {c} IS NOT NULL AND NOT ({cond.format(c=c)}) GROUP BY {c}" for c in cols]
    return "\nUNION ALL ".join(parts)


@register("range_issues", f"WITH {SURVEY_SQL}\n{_issues_sql(SURVEY_ITEMS, '{c} BETWEEN 1 AND 5')}")
def range_issues(spark, sf_dir):
    """F4 report: out-of-range values per column with their counts."""
    s = survey(spark, sf_dir)
    return quality.range_issues(s, SURVEY_ITEMS, 1, 5)


# --- fixed values: allowed answers of the proxy's text questions ------------
_ALLOWED = {"b1": ["Si", "No"], "t1": ["URGENT", "HIGH", "MEDIUM", "LOW"]}
# --------------------------------------------------------------------------


@register("domain_validate", f"""WITH {SURVEY_SQL}
SELECT row_id, CASE WHEN b1 IN ('Si', 'No') THEN b1 END AS b1,
       CASE WHEN t1 IN ('URGENT', 'HIGH', 'MEDIUM', 'LOW') THEN t1 END AS t1 FROM survey""")
def domain_validate(spark, sf_dir):
    """null answers outside each column's allowed set."""
    s = survey(spark, sf_dir).select("row_id", "b1", "t1")
    return quality.domain_validate(s, _ALLOWED)


@register("domain_issues", f"WITH {SURVEY_SQL}\n" + "\nUNION ALL ".join(
    _issues_sql([c], f"{{c}} IN ({', '.join(repr(v) for v in vals)})", "domain") for c, vals in _ALLOWED.items()))
def domain_issues(spark, sf_dir):
    """F6 report: out-of-domain answers per column with their counts."""
    return quality.domain_issues(survey(spark, sf_dir), _ALLOWED)


@register("token_to_null", f"""WITH {SURVEY_SQL}
SELECT row_id, nullif(t1, 'No aplica') AS t1 FROM survey""")
def token_to_null(spark, sf_dir):
    """F8: the 'No aplica' token becomes null."""
    s = survey(spark, sf_dir).select("row_id", "t1")
    return quality.token_to_null(s, ["t1"], "No aplica")


@register("token_counts", f"""WITH {SURVEY_SQL}
SELECT 't1' AS column_name, CAST(count(*) FILTER (WHERE t1 = 'No aplica') AS BIGINT) AS n_token FROM survey
UNION ALL SELECT 'b1', CAST(count(*) FILTER (WHERE b1 = 'No aplica') AS BIGINT) FROM survey""")
def token_counts(spark, sf_dir):
    """F8 report: token occurrences per column."""
    return quality.token_counts(survey(spark, sf_dir), ["t1", "b1"], "No aplica")


@register("digit_artifacts_to_null", f"""WITH {SURVEY_SQL}
SELECT row_id, CASE WHEN NOT regexp_matches(regexp_replace(b1, '^[\\s ]+|[\\s ]+$', '', 'g'), '^[0-9]+$')
                    THEN b1 END AS b1 FROM survey""")
def digit_artifacts_to_null(spark, sf_dir):
    """all-digit answers (question numbers) become null."""
    s = survey(spark, sf_dir)
    return s.select("row_id", tx.digits_to_null("b1").alias("b1"))


def _messy_customer(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 5
    return c.select("c_custkey", F.when(k == 0, F.regexp_extract("c_name", "#0*([0-9]+)", 1))
                    .when(k == 1, F.lit("nan"))
                    .when(k == 2, F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("\n")))
                    .when(k == 3, F.concat(F.lit("-"), F.col("c_nationkey").cast("string")))
                    .otherwise(F.col("c_mktsegment")).alias("cat"))


_MESSY_SQL = """mc AS (SELECT c_custkey,
  CASE WHEN c_custkey % 5 = 0 THEN regexp_extract(c_name, '#0*([0-9]+)', 1)
       WHEN c_custkey % 5 = 1 THEN 'nan'
       WHEN c_custkey % 5 = 2 THEN '  ' || c_mktsegment || chr(10)
       WHEN c_custkey % 5 = 3 THEN '-' || CAST(c_nationkey AS VARCHAR)
       ELSE c_mktsegment END AS cat FROM customer)"""
_STRIP_SQL = "regexp_replace(cat, '^[\\s ]+|[\\s ]+$', '', 'g')"


@register("valid_category_filter", f"""WITH {_MESSY_SQL}
SELECT c_custkey, CASE WHEN cat IS NOT NULL AND {_STRIP_SQL} NOT IN ('nan', 'None', '')
                        AND NOT regexp_matches({_STRIP_SQL}, '^-*[0-9]+$') THEN {_STRIP_SQL} END AS cat
FROM mc""")
def valid_category_filter(spark, sf_dir):
    """Valid category = stripped, not a 'nan' token, not a signed number."""
    m = _messy_customer(spark, sf_dir)
    return m.select("c_custkey", tx.valid_category("cat").alias("cat"))


@register("row_filters", f"""WITH {SURVEY_SQL}
SELECT row_id, seg, q1, t1 FROM survey
WHERE q1 IS NOT NULL AND seg = 'F' AND t1 IN ('URGENT', 'HIGH')""")
def row_filters(spark, sf_dir):
    """not-null, equality and membership filters (pushed into the scan)."""
    s = survey(spark, sf_dir)
    return (s.where(F.col("q1").isNotNull() & (F.col("seg") == "F") & F.col("t1").isin("URGENT", "HIGH"))
            .select("row_id", "seg", "q1", "t1"))


@register("dedupe_exact", """SELECT min(doc_id) AS doc_id, md5(text) AS text_md5, lang, source, n_chars
FROM documents GROUP BY text, lang, source, n_chars""")
def dedupe_exact(spark, sf_dir):
    """Exact duplicate documents, keep the smallest id."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    dd = quality.dedupe_exact(d, "doc_id")
    return dd.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@register("dedupe_key_keep_first", """SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice, o_orderpriority
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders)
WHERE rn = 1""")
def dedupe_key_keep_first(spark, sf_dir):
    """First order (smallest key) per (customer, status)."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice",
                                             "o_orderpriority")
    return quality.dedupe_by_key(o, ["o_custkey", "o_orderstatus"], "o_orderkey")


@register("duplicate_count", """SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_distinct,
       CAST(sum(c - 1) AS BIGINT) AS n_duplicates
FROM (SELECT text, count(*) AS c FROM documents GROUP BY text)""")
def duplicate_count(spark, sf_dir):
    """D3: how many documents repeat an earlier text."""
    d = load(spark, sf_dir, "documents").select("text")
    return quality.duplicate_count(d, ["text"])


_DIST_COLS = ["seg", "site", "cat_program", "q1", "q2", "q3", "q4", "b1", "b2", "t1"]


@register("distinct_profile", f"WITH {SURVEY_SQL}\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM survey"
    for c in _DIST_COLS))
def distinct_profile(spark, sf_dir):
    """Exact number of distinct answers per column."""
    return quality.distinct_profile(survey(spark, sf_dir), _DIST_COLS)


@register("append_rows", """SELECT c_custkey AS party_id, c_name AS name, c_acctbal AS acctbal,
       c_mktsegment AS segment FROM customer
UNION ALL
SELECT s_suppkey AS party_id, s_name AS name, s_acctbal AS acctbal, NULL AS segment FROM supplier""")
def append_rows(spark, sf_dir):
    """Append suppliers to customers by name, missing columns null."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party_id"), F.col("c_name").alias("name"),
                                               F.col("c_acctbal").alias("acctbal"),
                                               F.col("c_mktsegment").alias("segment"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("party_id"), F.col("s_name").alias("name"),
                                               F.col("s_acctbal").alias("acctbal"))
    return quality.append_rows(c, s)


# --- fixed values: the proxy's rename map ----------------------------------
_RENAME = {"c_custkey": "row_id", "c_mktsegment": "cat_segment", "c_name": "nombre",
           "c_acctbal": "saldo"}
# --------------------------------------------------------------------------


@register("rename_resolve", """SELECT c_custkey AS row_id, c_mktsegment AS cat_segment, c_nationkey AS nation,
       c_name AS nombre, round(c_acctbal, 6) AS saldo FROM customer""")
def rename_resolve(spark, sf_dir):
    """Rename by map, resolve by prefix/substring, select by prefix and type."""
    c = load(spark, sf_dir, "customer")
    r = schema.rename_columns(c, _RENAME)
    nation = schema.resolve_prefix(r.columns, "c_nationkey_of_customer", 6)
    bal = schema.first_available(r.columns, ["balance", "saldo"])
    texts = [x for x in schema.string_columns(r) if x == "nombre"]
    cats = schema.select_prefix(r, "cat_", keep=["row_id"])
    rest = r.select("row_id", F.col(nation).alias("nation"), *texts, r6(bal).alias("saldo"))
    return schema.align(cats, rest, "row_id")


@register("align_by_row_id", f"""WITH {SURVEY_SQL},
a AS (SELECT row_id, CASE WHEN q1 BETWEEN 1 AND 5 THEN q1 END AS q1v FROM survey),
b AS (SELECT row_id, CASE t1 WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3
                             WHEN 'NOT SPECIFIED' THEN 4 WHEN 'LOW' THEN 5 END AS t1_code FROM survey)
SELECT a.row_id, q1v, t1_code FROM a JOIN b ON a.row_id = b.row_id""")
def align_by_row_id(spark, sf_dir):
    """Two independently derived results re-attached by id (equi-join)."""
    s = survey(spark, sf_dir)
    a = s.select("row_id", quality.in_range("q1", 1, 5).alias("q1v"))
    m = F.create_map(*[F.lit(x) for kv in {"URGENT": 1, "HIGH": 2, "MEDIUM": 3, "NOT SPECIFIED": 4,
                                           "LOW": 5}.items() for x in kv])
    b = s.select("row_id", F.try_element_at(m, F.col("t1")).alias("t1_code"))
    return schema.align(a, b, "row_id")


@register("resolve_select", """SELECT c_custkey, c_nationkey, substr(c_name, 1, 10) AS short_name FROM customer""")
def resolve_select(spark, sf_dir):
    """Column found by substrings, listed columns that exist, truncated text."""
    c = load(spark, sf_dir, "customer")
    nation = schema.resolve_substrings(c.columns, "nation", "key")
    kept = schema.select_existing(c, ["c_custkey", nation, "no_such_column", "c_name"])
    return kept.select("c_custkey", nation, tx.truncate("c_name", 10).alias("short_name"))
