"""Wall time of headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES``
a comma list of keys to run instead of the headline set (``all`` for every key). Results are fully
computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from gridloom.plans import load_all
from gridloom.plans.registry import forget_shared
from gridloom.session import clear_scratch, get_session

HEADLINE = (
    "fact_load_with_fallback", "load_counts", "dimension_activity", "append_new",
    "sum_ifs", "average_ifs", "pivot_table", "scenario_grid",
    "lookup_exact", "lookup_asof", "workday_add", "parse_locale_number", "criteria_match", "json_repair",
    "describe_numeric", "column_profile", "infer_types", "issue_log", "business_rules", "fk_candidates",
    "read_delimited", "extract_table", "normalize_columns", "fuzzy_match",
    "insight_table", "segment_revenue", "inventory_metrics", "top_share", "cumulative_revenue",
    "cycle_nodes", "dedupe_suffix", "topological_depth", "connected_clusters", "nearest_label", "edge_list",
    "read_workbook_cells",
    "extracted_items", "section_of", "speaker_segments",
    "status_counts", "previous_state_gap", "progress_counts_stream", "job_sessions_stream",
)


def main() -> int:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    scratch = os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="gridloom-bench-")
    spark = get_session("bench", cores=cores, spark__checkpoint__dir=f"file://{scratch}")
    spark.sparkContext.setLogLevel("OFF")
    registry = load_all()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(registry) if wanted == "all" else wanted.split(",") if wanted else list(HEADLINE)
    # One small query first, so that session start-up is not charged to the first key.
    registry["table_shape"](spark, root).collect()
    seconds, failed = {}, {}
    for name in names:
        # Every key pays for the tables it derives.
        forget_shared()
        start = time.perf_counter()
        try:
            registry[name](spark, root).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as exc:  # noqa: BLE001 - the other keys still count
            failed[name] = f"{type(exc).__name__}: {exc}"[:200]
        print(f"{name} {time.perf_counter() - start:.1f}s", file=sys.stderr, flush=True)
    scale = os.path.basename(root.rstrip("/")).removeprefix("sf")
    result = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
              "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}
    if failed:
        result["failed"] = failed
    clear_scratch(spark)
    print(json.dumps(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
