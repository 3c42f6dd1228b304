"""Times the headline queries: BENCH_SF_DIR, BENCH_CPUS, one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["rule_hits", "findings_scored", "findings_redacted", "findings_dedup", "document_findings",
            "by_source", "report_json", "sarif_json", "chunks", "prompts", "inference_distinct", "cache_miss",
            "model_parse", "last_n", "diff_lines", "repository_scan"]
RUNS = 3


def main() -> None:
    from catalog.queries import QUERIES
    from keysift.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus,
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": f"total seconds, best of {RUNS}", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
