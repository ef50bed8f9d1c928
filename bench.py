"""Times of the headline queries, as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of threads. Results are computed in full and
thrown away. ``load_lineitem`` is the whole way of a text file into a versioned table: scan, stage, checks,
promotion, snapshot, registry.
"""

from __future__ import annotations

import json
import os
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.operators.validate import matches, not_null
from refload.plans.batch_load import load_files
from refload.plans.catalogue import QUERIES, table
from refload.plans.queries import load_all
from refload.plans.queries.scans import new_warehouse
from refload.session import build_session, new_folder
from refload.sources.delimited import DelimitedFormat, scan_delimited, write_delimited

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
HEADLINE = [
    "scan_delimited",
    "drop_trailer",
    "reject_ragged",
    "clean_null_tokens",
    "table_base_name",
    "classify_cell",
    "is_safe_widening",
    "detect_format",
    "infer_widths",
    "batch_load",
    "snapshot_version",
    "rollback_to_version",
    "page_version_rows",
    "append_load",
    "determine_load_type",
    "validate_stage",
    "schema_diff",
    "match_schema",
    "upsert_registry",
    "validate_load_config",
    "stable_files",
    "latest_state",
    "workflow_durations",
    "status_counts",
    "skip_in_flight",
    "legacy_union",
    "error_report",
    "recent_logs",
    "stream_transitions",
]


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def load_lineitem(spark: SparkSession) -> tuple[float, float, int]:
    """Seconds of a scan, seconds of a full load, and rows of ``lineitem`` from text; writing the text is not timed."""
    fmt = DelimitedFormat(column_delimiter="|")
    path = new_folder(spark, "bench")
    write_delimited(table(spark, SF_DIR, "lineitem"), path, fmt)
    started = time.perf_counter()
    drain(scan_delimited(spark, path, fmt))
    scanned = time.perf_counter() - started
    wh = new_warehouse(spark, "bench")
    rules = [not_null(1, "l_orderkey"), matches(2, "l_linenumber", r"^\d+$")]
    started = time.perf_counter()
    result = load_files(wh, path, "lineitem", fmt, "fullload", datetime(2024, 1, 31, 12, 0), rules)
    assert result.status == "success", result
    return scanned, time.perf_counter() - started, result.rows


def main() -> None:
    load_all()
    spark = build_session(f"local[{CPUS}]", "refload-bench", **{"spark.sql.shuffle.partitions": CPUS})
    drain(table(spark, SF_DIR, "region").select(F.upper("r_name")))
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        drain(QUERIES[name](spark, SF_DIR))
        times[name] = round(time.perf_counter() - started, 3)
    scanned, seconds, rows = load_lineitem(spark)
    times["scan_lineitem"] = round(scanned, 3)
    times["load_lineitem"] = round(seconds, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(os.path.normpath(SF_DIR)),
        "load_rows": rows,
        "load_rows_per_sec": round(rows / seconds),
        "scan_rows_per_sec": round(rows / scanned),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
