"""Summarise the final (post-AQE) physical plan of every driver query.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts shuffles, broadcasts and join strategies of the plan that produces
each result (intermediates written to the checkpoint folder are separate
jobs and appear as scans of the written copy).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textrisk.plans.registry import load_all  # noqa: E402
from textrisk.session import get_session  # noqa: E402

SKIP = {"oof_logreg", "oof_compare", "topic_model_sweep", "topic_seed_sweep", "seed_sweep", "topic_assign",
        "stream_screen_candidates"}
KINDS = [("hash shuffles", r"Exchange hashpartitioning"), ("range shuffles", r"Exchange rangepartitioning"),
         ("single-partition", r"Exchange SinglePartition"), ("broadcasts", r"BroadcastExchange"),
         ("sort-merge joins", r"SortMergeJoin"), ("broadcast joins", r"BroadcastHashJoin"),
         ("nested-loop joins", r"BroadcastNestedLoopJoin|CartesianProduct"),
         ("top-k limits", r"WindowGroupLimit|TakeOrderedAndProject"),
         ("sort aggregates", r"SortAggregate"), ("python", r"MapInPandas|ArrowEvalPython")]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    print(f"# Final physical plans at {os.path.basename(sf)} (post-AQE)\n")
    print("| query | " + " | ".join(k for k, _ in KINDS) + " |")
    print("|---|" + "---|" * len(KINDS))
    for name, q in load_all().items():
        if name in SKIP:
            continue
        df = q.build(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = [str(len(re.findall(p, plan))) for _, p in KINDS]
        print(f"| `{name}` | " + " | ".join(counts) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
