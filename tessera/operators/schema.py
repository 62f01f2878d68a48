"""Column resolution, renames and row identity.

Column-name work happens on the driver over ``df.columns`` (metadata only);
nothing here touches rows except ``add_row_id`` and ``align``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import saved

# --- fixed values -----------------------------------------------------------
# Curly quotes are folded to straight ones before names are compared (S-14).
QUOTE_FOLD = {"“": '"', "”": '"', "‘": "'", "’": "'"}
# --------------------------------------------------------------------------


def _fold(name: str) -> str:
    for a, b in QUOTE_FOLD.items():
        name = name.replace(a, b)
    return re.sub(r"[\s ]+", " ", name).strip()


def add_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Give every respondent an explicit id at the first stage.

    The numbered table is written to the shared folder and read again, so every
    later use sees the same ids, however often the source is read; later
    re-attachments are equi-joins on the id (never a positional alignment).
    """
    if name in df.columns:
        return df
    return saved(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def drop_if_present(df: DataFrame, cols: list[str]):
    """Drop the listed columns that exist; returns ``(df, dropped)``."""
    present = [c for c in cols if c in df.columns]
    return df.drop(*present), present


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by exact name, tolerant to quote style and blank runs (P4, S-14)."""
    folded = {_fold(k): v for k, v in mapping.items()}
    ren = {}
    for c in df.columns:
        if c in mapping:
            ren[c] = mapping[c]
        elif _fold(c) in folded:
            ren[c] = folded[_fold(c)]
    return df.withColumnsRenamed(ren)


def resolve_prefix(columns: list[str], prefix: str, n: int | None = None) -> str | None:
    """First column starting with ``prefix[:n]`` (P5)."""
    p = _fold(prefix if n is None else prefix[:n])
    for c in columns:
        if _fold(c).startswith(p):
            return c
    return None


def resolve_substrings(columns: list[str], *parts: str) -> str | None:
    """First column containing every part."""
    for c in columns:
        if all(p in c for p in parts):
            return c
    return None


def select_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep the listed columns that exist."""
    return df.select(*[F.col(f"`{c}`") for c in cols if c in df.columns])


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Names starting with ``prefix``."""
    return [c for c in df.columns if c.startswith(prefix)]


def select_prefix(df: DataFrame, prefix: str, keep: list[str] | tuple = ()) -> DataFrame:
    """``colRegex`` selection of ``prefix*`` columns plus ``keep``."""
    return df.select(*[F.col(k) for k in keep], df.colRegex(f"`^{re.escape(prefix)}.*`"))


def first_available(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate present."""
    for c in candidates:
        if c in columns:
            return c
    return None


def string_columns(df: DataFrame) -> list[str]:
    """Names of text columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns) — one count action (P10)."""
    return df.count(), len(df.columns)


def align(left: DataFrame, right: DataFrame, key: str = "row_id", how: str = "inner") -> DataFrame:
    """Re-attach two results of the same respondents by id.

    An equi-join: Spark picks broadcast or sort-merge from sizes; no
    positional concatenation.
    """
    return left.join(right, key, how)


def col(name: str) -> Column:
    """Column reference safe for names with dots, blanks or brackets."""
    return F.col(f"`{name}`")
