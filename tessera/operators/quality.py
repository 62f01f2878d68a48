"""Data-quality operators.

All column statistics are computed in **one** aggregation pass over all
columns (never one pass per column), and value validation is a projection,
so the whole cleaning stage is a couple of scans plus at most one shuffle for
duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# ---------------------------------------------------------------------------
# null profile and sparse columns
# ---------------------------------------------------------------------------

def null_fractions(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, n_null, null_frac)`` for every column, one scan (A1)."""
    cols = cols or df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(_q(c).isNull()).alias(f"_c{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_c{i}").alias("n_null"))
                                for i, c in enumerate(cols)]))
    return (one.select("_n", stack.alias("s"))
            .select(F.col("s.column_name").alias("column_name"), F.col("s.n_null").alias("n_null"),
                    (F.col("s.n_null") / F.col("_n")).alias("null_frac")))


def sparse_columns(df: DataFrame, threshold: float, cols: list[str] | None = None) -> list[str]:
    """Columns whose null fraction is strictly above ``threshold``.

    One aggregation; the result (one number per column) is collected.
    """
    prof = null_fractions(df, cols).where(F.col("null_frac") > threshold)
    return [r["column_name"] for r in prof.select("column_name").collect()]


def drop_sparse_columns(df: DataFrame, threshold: float, protect: list[str] | tuple = ("row_id",)):
    """Drop columns with null fraction > threshold; returns ``(df, dropped)``."""
    cand = [c for c in df.columns if c not in protect]
    dropped = sparse_columns(df, threshold, cand)
    return df.drop(*dropped), dropped


def row_null_fraction(cols: list[str]) -> Column:
    """Share of null answers of a row over ``cols`` (A2)."""
    n_null = sum((_q(c).isNull().cast("int") for c in cols), F.lit(0))
    return n_null / F.lit(float(len(cols)))


def drop_empty_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows where every column of ``cols`` is null (F1)."""
    return df.na.drop(how="all", subset=cols)


def drop_incomplete_rows(df: DataFrame, cols: list[str], threshold: float) -> DataFrame:
    """Drop rows whose null share over ``cols`` is strictly above ``threshold``."""
    return df.where(row_null_fraction(cols) <= threshold)


def drop_sentinel_rows(df: DataFrame, col: str, value: float) -> DataFrame:
    """Drop the rows whose ``col`` equals the sentinel; null rows stay (F2, S-1)."""
    return df.where(~_q(col).try_cast("double").eqNullSafe(F.lit(float(value))))


# ---------------------------------------------------------------------------
# value validation
# ---------------------------------------------------------------------------

def in_range(c: str, lo: float, hi: float) -> Column:
    """Coerce to double; null outside ``[lo, hi]``."""
    x = _q(c).try_cast("double")
    return F.when(x.between(lo, hi), x)


def range_validate(df: DataFrame, cols: list[str], lo: float, hi: float) -> DataFrame:
    """Coerce and null out-of-range values of ``cols`` (always coerces, S-4)."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: in_range(c, lo, hi) for c in present})


def _issue_table(df: DataFrame, cols: list[str], bad: dict[str, Column], check: str) -> DataFrame:
    """``(check, column_name, bad_value, n_invalid)``: one row per column and bad
    value, so that a free-text column gives a long table, never a long string."""
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "check string, column_name string, bad_value string, n_invalid bigint")
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), bad[c].alias("is_bad"), _q(c).cast("string").alias("value"))
        for c in cols]))
    long = df.select(stack.alias("s")).select("s.*").where("is_bad")
    return (long.groupBy("column_name", F.col("value").alias("bad_value"))
            .agg(F.count(F.lit(1)).alias("n_invalid"))
            .select(F.lit(check).alias("check"), "column_name", "bad_value", "n_invalid"))


def range_issues(df: DataFrame, cols: list[str], lo: float, hi: float,
                 check: str = "range") -> DataFrame:
    """The non-null values outside ``[lo, hi]`` per column, with their counts.

    Non-numeric text counts as invalid too (it becomes null on coercion).
    """
    present = [c for c in cols if c in df.columns]
    bad = {c: _q(c).isNotNull() & in_range(c, lo, hi).isNull() for c in present}
    return _issue_table(df, present, bad, check)


def domain_validate(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """Null values outside the allowed set of each column."""
    return df.withColumns({c: F.when(_q(c).isin(*vals), _q(c))
                           for c, vals in allowed.items() if c in df.columns})


def domain_issues(df: DataFrame, allowed: dict[str, list], check: str = "domain") -> DataFrame:
    present = [c for c in allowed if c in df.columns]
    bad = {c: _q(c).isNotNull() & ~_q(c).isin(*allowed[c]) for c in present}
    return _issue_table(df, present, bad, check)


def token_to_null(df: DataFrame, cols: list[str], token: str) -> DataFrame:
    """``nullif(col, token)`` for each column (F8)."""
    return df.withColumns({c: F.nullif(_q(c), F.lit(token)) for c in cols if c in df.columns})


def token_counts(df: DataFrame, cols: list[str], token: str) -> DataFrame:
    """``(column, n_token)`` — occurrences of the token per column, one pass."""
    present = [c for c in cols if c in df.columns]
    one = df.agg(*[F.count_if(_q(c) == token).alias(f"_t{i}") for i, c in enumerate(present)])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_t{i}").alias("n_token"))
                                for i, c in enumerate(present)]))
    return one.select(stack.alias("s")).select("s.*")


def positive_only(c: str) -> Column:
    """Drop level 0."""
    return F.when(_q(c) > 0, _q(c))


# ---------------------------------------------------------------------------
# duplicates
# ---------------------------------------------------------------------------

def row_digest(df: DataFrame, cols: list[str]) -> Column:
    """SHA-256 of the listed values, each written with its length.

    Rows have the same digest exactly if a ``GROUP BY`` over the columns would
    put them together (null equals null, -0.0 equals 0.0); shuffles carry 32
    bytes instead of whole texts.
    """
    from pyspark.sql import types as T

    parts = []
    for c in cols:
        v = _q(c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            v = v + F.lit(0.0)
        v = v.cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(
            F.concat(F.length(v).cast("string"), F.lit(":"), v)))
    return F.unhex(F.sha2(F.concat_ws(",", *parts), 256))


def dedupe_exact(df: DataFrame, order_col: str = "row_id") -> DataFrame:
    """Drop exact duplicates over all columns but ``order_col``; keep the first.

    The smallest id per row digest is combined map-side, so a group of a billion
    copies costs one row per task; the rows themselves are then picked by id.
    Ids are unique.
    """
    others = [c for c in df.columns if c != order_col]
    keep = (df.select(row_digest(df, others).alias("_d"), _q(order_col).alias("_id"))
            .groupBy("_d").agg(F.min("_id").alias("_id")).select("_id"))
    return df.join(keep, _q(order_col) == F.col("_id"), "left_semi")


def dedupe_by_key(df: DataFrame, keys: list[str], order_col: str = "row_id") -> DataFrame:
    """Keep the first row (smallest ``order_col``) of every key.

    The smallest id per key is a hash aggregate combined map-side, so a hot key
    never gathers its rows in one task; the rows are picked by id.  Null keys
    form one group (S-3).  Ids are unique.
    """
    keep = df.groupBy(*[_q(k) for k in keys]).agg(F.min(_q(order_col)).alias("_id")).select("_id")
    return df.join(keep, _q(order_col) == F.col("_id"), "left_semi")


def duplicate_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows minus distinct rows over ``keys`` (D3): one row ``(n_rows, n_distinct, n_duplicates)``."""
    keys = keys or df.columns
    g = df.select(row_digest(df, keys).alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("cnt"))
    return g.agg(F.sum("cnt").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                 F.sum(F.col("cnt") - 1).alias("n_duplicates"))


def distinct_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, n_distinct)`` — exact, two-stage.

    Distinct (column, value) pairs first, then a count per column: both stages
    combine map-side.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("value"))
                                for c in cols]))
    pairs = df.select(stack.alias("s")).select("s.*").where(F.col("value").isNotNull()).distinct()
    return pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def append_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Append rows by column name, missing columns as null."""
    return df.unionByName(other, allowMissingColumns=True)


def strip_all_text(df: DataFrame) -> DataFrame:
    """Strip every string column."""
    from pyspark.sql import types as T
    return df.withColumns({f.name: tx.strip(_q(f.name)) for f in df.schema.fields
                           if isinstance(f.dataType, T.StringType)})
