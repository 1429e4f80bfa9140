"""Write PLANS.md: the final physical operator chain of every registered
query (run at the given scale), to review shuffles, scans and Python stages.

usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODE = re.compile(r"^[\s+\-:|]*(\*\(\d+\)\s*)?([A-Za-z]+)(.*)$")


def chain(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    steps = []
    for line in plan.splitlines():
        m = NODE.match(line)
        if not m or m.group(2) in ("AdaptiveSparkPlan", "ResultQueryStage", "ShuffleQueryStage",
                                   "AQEShuffleRead", "ColumnarToRow", "Final", "Initial",
                                   "TableCacheQueryStage", "InputAdapter"):
            if "== Initial Plan ==" in line:
                break
            continue
        name, rest = m.group(2), m.group(3)
        if name == "FileScan":
            cols = re.search(r"\[([^\]]*)\]", rest)
            name = f"Scan[{re.sub(r'#[0-9]+L?', '', cols.group(1)) if cols else ''}]"
        elif name == "Exchange":
            kind = re.search(r"(hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning|"
                             r"shufflepartitionidpassthrough)", rest)
            name = f"Exchange({kind.group(1) if kind else ''})"
        elif name == "HashAggregate":
            name = "HashAggregate(partial)" if "partial_" in rest else "HashAggregate(final)"
        steps.append(name)
    return " <- ".join(steps)


def main():
    from tessera.plans.queries import QUERIES
    from tessera.session import local_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    lines = ["# Physical plans", "",
             f"Final (adaptive) operator chains, root first, at `{os.path.basename(sf_dir)}`; "
             "generated by `tools/plans.py`. `Exchange` is a shuffle; `ArrowEvalPython`, "
             "`MapInPandas`, `MapInArrow` are Arrow-batched Python stages; `LogicalRDD`/"
             "`Scan ExistingRDD` read a checkpointed or written table.", "",
             "| query | plan |", "| --- | --- |"]
    for name, fn in QUERIES.items():
        try:
            lines.append(f"| {name} | {chain(fn(spark, sf_dir))} |")
        except Exception as e:  # keep going
            lines.append(f"| {name} | error: {type(e).__name__} |")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
