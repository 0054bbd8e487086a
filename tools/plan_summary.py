"""Summarise the physical plans of the headline queries (writes PLANS.md).

    python tools/plan_summary.py [sf_dir]

Counts shuffles, broadcasts, join strategies, windows and aggregates in the
planned (pre-AQE) physical plan and lists the filters pushed to each scan.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from carelog.plans.catalog import QUERIES  # noqa: E402
from carelog.session import get_spark  # noqa: E402

OPS = ["Exchange hashpartitioning", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin",
       "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "Window ", "WindowGroupLimit",
       "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Scan parquet", "ArrowEvalPython"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    lines = ["# Physical plans of the headline queries", "",
             f"Planned (pre-AQE) physical plans at `{sf}`, from `tools/plan_summary.py`. Counts are "
             "operator occurrences; `Exchange` is a shuffle. Study-table steps written to the checkpoint "
             "folder appear as scans of those tables.", "",
             "| query | " + " | ".join(o.strip() for o in OPS) + " |",
             "|---" * (len(OPS) + 1) + "|"]
    pushed = []
    for name in HEADLINE:
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines.append(f"| {name} | " + " | ".join(str(plan.count(o)) for o in OPS) + " |")
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        for m in re.finditer(r"PushedFilters: \[([^\]]*)\]", buf.getvalue()):
            if m.group(1):
                pushed.append(f"- `{name}`: {m.group(1)[:160]}")
    lines += ["", "## Filters pushed to parquet scans", ""] + sorted(set(pushed))
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    open(out, "w").write("\n".join(lines) + "\n")
    print(open(out).read())


if __name__ == "__main__":
    main()
