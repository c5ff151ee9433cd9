"""Write the physical plans of the key queries to docs/PLANS.md.

usage: python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from riskweave.plans import registry as R  # noqa: E402
from riskweave.session import local_session  # noqa: E402

#: Lines of each plan that are shown.
LINES = 24

KEYS = [
    ("p4_portfolio_summary", "one Expand + one shuffle for the three roll-ups; pruned scans; "
                             "age filter pushed into both scans"),
    ("e9_row_num", "global row number: windows partitioned by the equi-depth bucket, offsets "
                   "from a bounded bucket table (broadcast)"),
    ("m3_split_assignment", "stratified split: counts per class and hash, one scalar of the ends "
                            "of each class's test rows; the frame is not shuffled"),
    ("d13_correlation", "pairwise-complete correlations: each task reduces its rows to one row "
                        "of moments per pair"),
    ("d12_util_histogram_by_class", "per-class histogram: per-class edges broadcast, counts "
                                    "with partial aggregation"),
    ("m7_roc_reduced_rule_score", "bounded ROC: distinct-score aggregate, bucketed prefix sums, "
                                  "points that enter a cell of either axis"),
    ("d2_describe", "moments and quartile bounds of all columns in one aggregate, then only "
                    "the values between the bounds ordered"),
    ("a3_row_key", "row numbers of a file scan: counts per split, a prefix over them, "
                   "broadcast back to the scan"),
    ("d16_value_counts", "top 10 values per column: partial WindowGroupLimit before the "
                         "exchange"),
]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8)
    out = ["# Physical plans of key queries", "",
           f"Generated by `tools/dump_plans.py` on `{sf}` (local[8], 8 shuffle partitions, "
           "AQE on; plans before adaptive re-optimization; long expression lines cut at "
           f"180 characters, plans after {LINES} lines).", "",
           "Every `Exchange SinglePartition` below sits on top of a hash aggregate — a "
           "per-bucket total (at most one row per bucket) or a global aggregate's final "
           "merge — never on row-sized data.", ""]
    for key, note in KEYS:
        df = R.QUERIES[key](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [ln if len(ln) <= 180 else ln[:177] + "..." for ln in plan.rstrip().split("\n")]
        lines = lines[:LINES] + ["..."] * (len(lines) > LINES)
        out += [f"## `{key}`", "", note + ".", "", "```", *lines, "```", ""]
    with open(os.path.join(ROOT, "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
