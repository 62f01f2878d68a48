"""Audit the physical plans of registered queries: all that ran, not only the last.

usage: python tools/plan_audit.py [sf_dir] [--log DIR] [--write docs/PLANS.md] [name ...]

Every query runs to completion (Parquet into the log folder) in a session that
writes Spark's event log there.  The log holds the final plan of each job,
also of those that a query ran before it returned.  A query is flagged if one
of them has a cartesian product, a nested-loop join or a row-at-a-time Python
UDF; joins, exchanges and scans are summed up.  ``--write`` saves the formatted
plans of the headline queries.
"""

from __future__ import annotations

import io
import json
import os
import sys
import tempfile
from collections import Counter
from contextlib import redirect_stdout
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans.catalog import all_queries  # noqa: E402
from tessera.session import get_session  # noqa: E402

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
HEADLINE = ["competence_profile", "kruskal_wallis", "row_filters", "dedupe_key_keep_first", "top_n_per_group",
            "lump_rare", "quantile_normal", "eps_neighbors"]


def nodes(plan: dict, found: Counter) -> Counter:
    found[plan["nodeName"].split(" (")[0].strip()] += 1
    for child in plan["children"]:
        nodes(child, found)
    return found


def executed(log: Path, begin: dict) -> dict[str, Counter]:
    """query -> operators of the last plan of each of its executions."""
    plans, when = {}, {}
    for path in log.rglob("*"):
        if not path.is_file() or path.name.startswith("."):
            continue
        for line in path.open(errors="replace"):
            if '"sparkPlanInfo"' not in line:
                continue
            e = json.loads(line)
            plans[e["executionId"]] = e["sparkPlanInfo"]
            if "time" in e:
                when[e["executionId"]] = e["time"]
    out: dict[str, Counter] = {name: Counter() for name in begin}
    marks = sorted((t, name) for name, t in begin.items())
    for i, plan in plans.items():
        name = max(((t, n) for t, n in marks if t <= when.get(i, 0)), default=(0, None))[1]
        if name:
            nodes(plan, out[name])
    return out


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    option = {}
    for flag in ("--write", "--log"):
        if flag in args:
            i = args.index(flag)
            option[flag] = args[i + 1]
            del args[i:i + 2]
    log = Path(option.get("--log") or tempfile.mkdtemp(prefix="tessera-audit-"))
    (log / "events").mkdir(parents=True, exist_ok=True)
    spark = get_session(shuffle_partitions=8, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log}/events",
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    clock = spark.sparkContext._jvm.java.lang.System.currentTimeMillis
    begin, docs = {}, []
    for name in args or list(all_queries()):
        begin[name] = clock()
        df = all_queries()[name](spark, sf_dir)
        df.write.parquet(f"{log}/out/{name}")
        if "--write" in option and name in HEADLINE:
            buf = io.StringIO()
            with redirect_stdout(buf):
                df.explain("formatted")
            docs.append(f"## {name}\n\n```\n{buf.getvalue().strip()}\n```\n")
    spark.stop()
    flagged = 0
    for name, found in executed(log / "events", begin).items():
        bad = [b for b in BAD if found[b]]
        flagged += bool(bad) or not any("Scan parquet" in k for k in found)
        kinds = {k: n for k, n in found.items() if "Join" in k or k in ("Exchange", "BroadcastExchange")}
        scans = sum(n for k, n in found.items() if "Scan parquet" in k)
        print(f"{'BAD ' if bad else 'ok  '}{name}: {scans} scans, {dict(kinds)} {' '.join(bad)}")
    if "--write" in option:
        Path(option["--write"]).write_text(
            "# Physical plans of headline queries (sf0.001, local)\n\n"
            "Generated by `tools/plan_audit.py --write`.\n\n" + "\n".join(docs))
    print(f"{flagged} queries flagged")
    sys.exit(int(flagged > 0))


if __name__ == "__main__":
    main()
