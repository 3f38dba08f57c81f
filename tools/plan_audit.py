"""Physical-plan audit of every registered query: shuffles, broadcasts,
windows, Python stages, and a hard check that no cartesian / nested-loop
join appears.  Prints a markdown table.

    python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from corvid.plans import QUERIES  # noqa: E402
from corvid.session import build_session  # noqa: E402

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def audit(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin", plan)),
        "single_partition": plan.count("SinglePartition"),
        "broadcasts": plan.count("BroadcastExchange"),
        "windows": len(re.findall(r"\bWindow \[", plan)) + plan.count("WindowGroupLimit"),
        "python": len(re.findall(r"FlatMapCoGroupsInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)),
        "forbidden": [f for f in FORBIDDEN if f in plan],
    }


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    print("| query | shuffles | of which single-partition | broadcasts | windows | python stages |")
    print("| --- | --- | --- | --- | --- | --- |")
    bad = 0
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()  # final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        a = audit(plan)
        bad += bool(a["forbidden"])
        flag = f" **{a['forbidden']}**" if a["forbidden"] else ""
        print(f"| {name}{flag} | {a['shuffles']} | {a['single_partition']} | {a['broadcasts']} | {a['windows']} | {a['python']} |")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
