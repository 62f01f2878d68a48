"""A slice of the registered queries against their DuckDB twins at sf0.001,
plus the driver-contract smoke checks."""

import math

import duckdb
import pytest

from tessera.plans.catalog import all_oracles, all_queries
from tessera.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["competence_profile", "kruskal_wallis", "null_profile", "range_issues", "dedupe_key_keep_first",
        "binary_encode", "keyword_rules", "change_classes_rollup", "lump_rare", "freq_share", "top_n_per_group",
        "grouped_stats", "box_summary", "kmo_bartlett", "quantile_normal", "silhouette", "select_k",
        "eps_neighbors", "ingest_flow", "quality_report", "report_flow"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(str, t)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = all_queries()[name](spark, SF)
    rel = con.execute(all_oracles()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, rel.fetchall())


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0 and "p_value" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
