"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from holdfast.plans.queries import QUERIES  # noqa: E402
from holdfast.session import get_session  # noqa: E402

HEADLINE = [
    "summary",
    "summary_orders",
    "holdout_orders",
    "holdout_entity",
    "take_k",
    "prefix_sum",
    "balance_even",
    "balance_replace",
    "gnb_predict",
    "roc_auc_orders",
    "impute_median",
    "scale_robust",
    "encode_target",
    "apply_params",
    "select_anova",
    "wilcoxon",
    "subgroups_orders",
    "fairness_summary",
    "audit_entity",
    "audit_copies",
    "audit_complete",
    "seed_reuse",
    "check_claims",
    "fingerprint",
    "pii_scan",
    "profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "holdfast-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="holdfast-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["holdout"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
