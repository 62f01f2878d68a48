"""Query catalogue: every registered query is a Spark callable ``(spark,
sf_dir) -> DataFrame`` and, where the result is expressible in SQL, an
independent oracle statement over the raw test tables.

Conventions for oracle parity: every computed column is aliased to the same
name on both sides; counts are BIGINT; floating results are rounded to 6
decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

ROUND = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    """Round a floating result for the oracle comparison."""
    return F.round(F.col(c) if isinstance(c, str) else c, ROUND)


def sql_long(src: str, cols: list[str], keep: list[str] | tuple = (), drop_nulls: bool = True) -> str:
    """SQL unpivot as UNION ALL (column name as ``var``, value as ``val``)."""
    parts = []
    for c in cols:
        ks = "".join(f"{k}, " for k in keep)
        where = f" WHERE {c} IS NOT NULL" if drop_nulls else ""
        parts.append(f"SELECT {ks}'{c}' AS var, CAST({c} AS DOUBLE) AS val FROM {src}{where}")
    return "\nUNION ALL ".join(parts)


def _load_all() -> None:
    # importing the query modules fills QUERIES / ORACLE
    from tessera.plans import (q_quality, q_encode, q_profile, q_stats,  # noqa: F401
                               q_latent, q_validate, q_segment, q_flows, q_report)


def all_queries() -> dict[str, Callable]:
    _load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
