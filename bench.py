"""Benchmark: time the headline queries on the driver tables.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_QUERIES (comma list; default the headline set, "all"
for every registered query). Each query is executed in full with the
no-op sink (no collect). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loanbook.plans import catalog  # noqa: E402
from loanbook.session import get_spark  # noqa: E402

HEADLINE = [
    "k10_report", "a5_provisions", "r6_report", "r5_scenarios", "c11_accepted",
    "c14_null_policy", "c16_review_clean", "q5_loss_profit", "a1_kpis", "j2_compile",
    "d1_matrix", "w1_top_exposure", "a3_sweep", "p1_sample", "p4_strata", "p7_disjoint",
    "m4_woe", "q8_selection",
    "m1_ordinal", "m2_onehot", "m3_fit_bins", "m4_fitted", "m8_calibrated", "c15_model_impute", "j6_financials", "a9_metrics", "d4_economic_lgd",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", app="loanbook-bench", shuffle_partitions=max(8, cpus * 2))
    catalog.load_all()
    # untimed JVM / code-generation warm-up on the smallest tables (a different
    # dataset: nothing from the timed tables is read or cached here)
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("k10_report", "q5_loss_profit", "p1_sample"):
            catalog.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    sel = os.environ.get("BENCH_QUERIES", "")
    names = sorted(catalog.QUERIES) if sel == "all" else (
        [s for s in sel.split(",") if s] or [n for n in HEADLINE if n in catalog.QUERIES])
    times, errors = {}, {}
    for name in names:
        t = time.time()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t, 3)
            spark.catalog.clearCache()  # each query stands alone (untimed)
        except Exception as e:  # keep going; report the failure
            errors[name] = repr(e)[:200]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
