"""Wall time of the headline queries; prints one JSON line.

Every query is run to its last row into a sink that discards them.  Set
BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma separated, or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time

from gradeflow.plans import registry
from gradeflow.session import local_session

HEADLINE = (
    "eval_summary", "eval_summary_lines", "check_answers", "parse_binary", "result_filters", "failed_runs",
    "cost_by_provider", "cost_estimate", "image_tokens", "import_outcomes", "import_upsert", "annotation_stats",
    "export_annotations", "select_random_percent", "select_percent_lines", "resume_remaining", "eval_list",
    "eval_groups", "dashboard", "dup_cleanup_plan", "dup_keep_latest", "size_batches", "keyword_labels",
    "prompt_substitute", "take_up_files", "job_totals", "progress_log", "upload_totals", "stream_labels",
    "inference_chain", "nearest_examples",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = registry.queries()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = local_session(cpus, 8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("annotation_stats")  # start the session's threads and caches
    times = {}
    for name in names:
        times[name] = run(name)
        print(f"{name:28s} {times[name]:8.3f} s", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
