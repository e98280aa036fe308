"""Scan the physical plan of every registered query for shapes that do not scale.

Flags: CartesianProduct, BroadcastNestedLoopJoin, and single-partition exchanges
(global windows / sorts).  Single-partition exchanges are acceptable only over
tables bounded by the class, feature or bucket count; the report lists the
operator under each so that can be checked.

Usage: python tests/plan_audit.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def audit(plan: str) -> list[str]:
    issues = []
    for pat in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if pat in plan:
            issues.append(pat)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = next((l.strip() for l in lines[i + 1 : i + 4] if l.strip()), "")
            issues.append("SinglePartition over: " + re.sub(r"#\d+L?", "", below)[:140])
    return issues


def main(argv: list[str]) -> None:
    sf_dir = next((a for a in argv if a.startswith("/")), "/root/testdata/sf0.001")
    names = [a for a in argv if not a.startswith("/")]
    from flowlens.session import get_spark
    import __spark_entry__ as E

    spark = get_spark("plan-audit")
    for name, fn in sorted(E.queries().items()):
        if names and name not in names:
            continue
        try:
            plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        except Exception as exc:
            print(f"{name}: ERROR {type(exc).__name__}")
            continue
        found = audit(plan)
        print(f"{name}: {'clean' if not found else '; '.join(found)}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
