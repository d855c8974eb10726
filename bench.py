"""Times the headline queries, each run to a no-op sink; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rollcall.plans.all import QUERIES
from rollcall.session import session

HEADLINE = ("j01_spine", "a01_membership_summary", "a04_distribution", "a07_gini", "a10_cohort_survival", "a17_fractional", "j07_self_join", "j14_related", "w03_running_top5",
            "g04_session_links", "t03_term_frequencies", "t07_co_occurrence", "t16_tf_idf_top3", "t12_rule_coding", "x03_spearman", "x07_kaplan_meier", "q06_report", "stream_sessions",
            "q05_json_schema", "j08_interval_without_key", "j12_fuzzy_best_match", "t03_stem_frequencies", "t18_close_documents", "x05_permutation", "x06_bootstrap")


def main() -> None:
    root, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):  # the first run compiles and warms the file cache
            start = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(root.rstrip("/"))}), flush=True)


if __name__ == "__main__":
    main()
