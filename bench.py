"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set scale and cores, BENCH_SHARED_DIR the
folder for written tables (a fresh temporary one otherwise).
Each query runs once to warm up, then once timed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from salmoura.checks import all_entries  # noqa: E402
from salmoura.session import build_session  # noqa: E402

HEADLINE = [
    "a14_analysis_table_window",
    "a14_analysis_table_nearest",
    "a4_well_month_medians",
    "w1_carry_forward",
    "a2_a3_platform_summary",
    "j1_append_newer",
    "a17_j7_temporal_table",
    "c4_keep_first",
    "c15_waste_platform_code",
    "m6_stratified_folds",
    "m8_youden_threshold",
    "m10_auc",
    "m17_score_batch",
    "a19_spearman_with_ties",
    "a21_g3_boxplots",
    "g5_convex_hull",
    "g6_inside_polygon",
    "m16_compare_models",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # everything runs in this one process, so a folder of this machine is shared by all; a cluster names its own
    shared = os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__checkpoint__dir=shared,
        spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = all_entries()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(scale) if scale[:1].isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
