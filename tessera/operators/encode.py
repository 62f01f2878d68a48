"""Encoders (E1–E23, J2, J3, A12, X1–X15).

Every encoder is a column expression (a literal ``map`` lookup, a ``CASE``
chain or arithmetic) evaluated inside whole-stage codegen; the one encoder that
needs data-dependent information (rare-category lumping) looks the kept values up
in a size-checked table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans import survey_config as cfg
from tessera.sources.scratch import BROADCAST_ROWS, saved


def _q(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def map_values(c, mapping: dict) -> Column:
    """Dictionary lookup; unmapped and null values give null.

    A literal map plus ``try_element_at``: constant-folded once, no join.
    """
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    col = _q(c)
    return F.when(col.isNotNull(), F.try_element_at(m, col))


def encode_columns(df: DataFrame, mapping: dict, cols: list[str], suffix: str = "") -> DataFrame:
    """Apply one scale to many columns."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c + suffix: map_values(c, mapping) for c in present})


def binary_encode(c, yes: list[str], no: list[str]) -> Column:
    """Yes/No spellings → 1/0, anything else → null."""
    m = {**{y: 1 for y in yes}, **{n: 0 for n in no}}
    return map_values(c, m).cast("int")


def decode_values(c, mapping: dict) -> Column:
    """Reverse lookup code → label."""
    return map_values(c, mapping)


def keyword_level(c, rules: list[tuple[int, list[str]]], default: int,
                  null_levels: tuple = (), lower: bool = True) -> Column:
    """Ordered keyword rules on free text → level.

    Text is stripped and lower-cased; all-digit strings → null; the first rule
    with a keyword contained in the text wins; no match → ``default``; levels in
    ``null_levels`` (e.g. "no job") are then nulled (F14).  Substring matching,
    as the reference (S-5).
    """
    v = tx.strip(_q(c).cast("string"))
    if lower:
        v = F.lower(v)
    out = F.when(_q(c).isNull() | F.regexp_like(v, F.lit(tx.DIGITS_PATTERN)), F.lit(None).cast("int"))
    for level, words in rules:
        out = out.when(tx.contains_any(v, words), F.lit(level))
    out = out.otherwise(F.lit(default))
    if null_levels:
        out = F.when(~out.isin(*null_levels), out)
    return out


def change_score(current: str, previous: str, lo: float, hi: float) -> Column:
    """current − previous, both validated to ``[lo, hi]``."""
    a = _q(current).try_cast("double")
    b = _q(previous).try_cast("double")
    return F.when(a.between(lo, hi) & b.between(lo, hi), a - b)


def sign_label(c, up: str = "Ascenso", same: str = "Sin cambio", down: str = "Descenso") -> Column:
    """Label of the sign of a change."""
    x = _q(c)
    return F.when(x > 0, F.lit(up)).when(x == 0, F.lit(same)).when(x < 0, F.lit(down))


def coalesce_chain(*cols) -> Column:
    """First non-null of several columns."""
    return F.coalesce(*[_q(c) for c in cols])


def nominal_clean(c, replace: dict | None = None, valid: list[str] | None = None,
                  upper: bool = False) -> Column:
    """Digits → null, strip, optional upper-case, replace map, keep valid set.

    Operator order is replace → validate (S-6).
    """
    v = tx.digits_to_null(_q(c).cast("string"))
    v = tx.strip(v)
    if upper:
        v = F.upper(v)
    if replace:
        v = tx.replace_map(v, replace)
    if valid is not None:
        v = F.when(v.isin(*valid), v)
    return v


def lump_many(df: DataFrame, lumps: list[tuple[str, int, str]], salt: int = 32) -> DataFrame:
    """For every ``(column, min_count, other)``: values seen fewer than ``min_count``
    times → ``other``; null kept (E19, J3).  Upper-case + strip first.

    One pass counts the values of all columns.  Only the kept values are needed:
    while they are few (checked) they are broadcast, so the rows are not shuffled.
    Beyond that rows and values are salted, so that a hot category, or the nulls,
    spread over ``salt`` tasks.
    """
    cleaned = {c: F.upper(tx.strip(_q(c).cast("string"))) for c, _, _ in lumps}
    least = F.array(*[F.lit(int(n)) for _, n, _ in lumps])
    items = F.array(*[F.struct(F.lit(i).alias("i"), cleaned[c].alias("v")) for i, (c, _, _) in enumerate(lumps)])
    kept = saved(df.select(F.explode(items).alias("x")).where("x.v is not null")
                 .groupBy(F.col("x.i").alias("_i"), F.col("x.v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
                 .where(F.col("_n") >= least[F.col("_i")]).select("_i", "_v"), "categories")
    few = kept.count() <= BROADCAST_ROWS
    out = df
    if not few:
        out = out.withColumn("_salt", F.pmod(F.xxhash64(*[_q(c) for c in df.columns]), F.lit(salt)))
    for i, (c, _, other) in enumerate(lumps):
        mine = kept.where(F.col("_i") == i).select(F.col("_v").alias("_lump"))
        if few:
            out = out.join(F.broadcast(mine), cleaned[c] == F.col("_lump"), "left")
        else:
            mine = mine.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
            out = out.join(mine, (cleaned[c] == F.col("_lump")) & (F.col("_salt") == F.col("_t")), "left").drop("_t")
        out = out.withColumn(c, F.when(cleaned[c].isNull(), F.lit(None).cast("string"))
                             .when(F.col("_lump").isNotNull(), F.col("_lump")).otherwise(F.lit(other))).drop("_lump")
    return out if few else out.drop("_salt")


def lump_rare(df: DataFrame, col: str, min_count: int = cfg.RARE_CATEGORY_MIN, other: str = cfg.RARE_CATEGORY_LABEL,
              out: str | None = None, salt: int = 32) -> DataFrame:
    """:func:`lump_many` for one column, written to ``out``."""
    if out is None or out == col:
        return lump_many(df, [(col, min_count, other)], salt)
    return lump_many(df.withColumn(out, _q(col)), [(out, min_count, other)], salt)


def additive_score(cols: list[str]) -> Column:
    """Row-wise sum with nulls as 0; all-null → 0."""
    present = [_q(c).try_cast("double") for c in cols]
    return sum((F.coalesce(c, F.lit(0.0)) for c in present), F.lit(0.0))


def name_segments(c, names: dict, prefix: str = cfg.SEGMENT_NAME_PREFIX) -> Column:
    """Segment code → name, default ``prefix + code``."""
    col = _q(c)
    return F.coalesce(map_values(col, names), F.concat(F.lit(prefix), col.cast("string")))


def age_years(date_col, ref: str = "2026-01-01", lo: float | None = 18, hi: float | None = 80) -> Column:
    """Years between a date and ``ref`` (days / 365.25), bounded.

    Text dates are parsed with ``try_to_date`` (unparseable → null)."""
    d = _q(date_col)
    d = F.to_date(d) if not isinstance(date_col, str) else F.coalesce(
        F.try_to_date(d.cast("string")), F.to_date(d))
    age = F.datediff(F.lit(ref).cast("date"), d) / 365.25
    if lo is None:
        return age
    return F.when(age.between(lo, hi), age)


def year_of(date_col, lo: int = 1970, hi: int = 2026) -> Column:
    """Calendar year, bounded."""
    y = F.year(_q(date_col))
    return F.when(y.between(lo, hi), y)
