"""
$BENCH_SF_DIR (default sf0.1).  Each query is planned fresh and executed as a
full ``noop`` write; the value per query is the median of 3 warm runs.
Prints ONE JSON line."""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mktlens.plans import REGISTRY  # noqa: E402
from mktlens.session import local_session  # noqa: E402

# BASELINE ids -> registered queries
HEADLINE = {
    "X1": "X1_build_features",
    "W3": "W3_rolling_mean",
    "W13": "X10_window_samples",
    "J3": "J3_alias_text_match",
    "J6": "J6_fuzzy_alias_lookup",
    "A14": "A14_roc_auc",
}


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    REGISTRY.queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="mktlens-bench")
    out = {}
    for short, name in HEADLINE.items():
        run_once(spark, name, sf_dir)  # warm-up (JIT, file listing, python workers)
        out[short] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(reps)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
