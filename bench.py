"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores,
BENCH_QUERIES an optional comma-separated list of query names.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright import build_session  # noqa: E402
from tablewright.catalog.queries import QUERIES  # noqa: E402

HEADLINE = (
    "p1_p3_shape", "p5_null_profile", "p6_distinct_counts", "p8_numeric_profile", "p9_top_values",
    "m1_m4_missing_profile", "f2_lexical_types", "f1_format_issues", "b_broken_counts", "b5_unparseable_dates",
    "d1_exact_duplicates", "d2_duplicate_rows", "d4_near_pairs", "d4_near_pairs_customers", "d5_key_repeats",
    "o2_zscore_outliers", "o3_iqr_outliers", "c1_case_variants", "r1_r10_decisions",
    "x1_null_placeholders", "x2_x3_impute_numeric", "x4_impute_dates", "x5_impute_mode", "x6_ascii_fold", "x7_iso_dates",
    "x11_cap_outliers", "x12_text_case", "x13_x15_column_names", "x16_drop_duplicates", "x17_near_flags_greedy",
    "x19_canonical_spelling", "s1_s2_csv_round_trip", "v2_before_after", "v5_clean_full",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()      # start-up is not measured
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
