"""No cartesian products / nested-loop joins / row-at-a-time Python UDFs in any plan that
ran for a query: earlier jobs of a query are audited as well as its last one."""

from tessera.plans.catalog import all_queries

SF = "/root/testdata/sf0.001"


def test_executed_plans_have_no_cross_join(tmp_path):
    """All queries below run in a session of their own that logs its events."""
    import subprocess
    import sys
    from pathlib import Path

    tool = Path(__file__).resolve().parent.parent / "tools" / "plan_audit.py"
    names = ["freq_share", "ari", "features_flow", "competence_profile", "top_n_per_group", "lump_rare",
             "eps_neighbors", "quantile_normal", "nearest_centroid", "compare_methods", "report_full"]
    out = subprocess.run([sys.executable, str(tool), SF, "--log", str(tmp_path), *names], capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stdout[-3000:] + out.stderr[-2000:]
    assert "0 queries flagged" in out.stdout
    assert out.stdout.count("ok ") == len(names)


def test_scan_prunes_and_pushes(spark):
    df = all_queries()["row_filters"](spark, SF)
    txt = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in txt           # predicate reaches the Parquet reader
    scans = [line for line in txt.split("\n") if "FileScan parquet" in line and "orders.parquet" in line]
    assert scans and "o_totalprice" not in scans[0]    # unused columns are pruned from the read
