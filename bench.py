"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans import registry
from tidemark.session import local_session

HEADLINE = [
    "flagship_turn_summary",
    "s9_ticks_to_bars",
    "f35_feature_bank",
    "l7_label_turns",
    "v5_fold_table",
    "e1_match_counts",
    "e6_average_precision",
    "e16_pbo_cscv",
    "d19_cooldown",
    "d1_default_preset_high",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    rows = registry.QUERIES["s9_ticks_to_bars"](spark, sf_dir).count()
    out = {
        "metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")), "bars": rows,
    }
    if "f35_feature_bank" in took:
        out["bank_rows_per_sec"] = round(rows / took["f35_feature_bank"])
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
