"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "k1_export_plan", "k2_interchange_rows", "f1_place_items", "f2_merge_gaps", "e3_export_extent", "d3_locate_frames", "d5_bracket_pts",
    "d10_relink", "i1_remove_items", "i4_insert_items", "i5_split_items", "i7_replace_items", "f3_detect_cuts_diff", "f4_cuts_to_shots",
    "k5_detect_shots_diff", "k6_thumbnail_plan", "j1_sample_tracks", "k3_crop_jobs_native", "k8_segment_placement", "e14_duplicate_summary",
    "f12_retain_versions", "l1_audit_rational",
]


def edit_workload(spark, clips: int) -> float:
    """Seconds to split every 3rd clip of a timeline of 48-frame clips in the middle and ripple-delete every 5th item of the result."""
    from pyspark.sql import functions as F
    from shotweave.operators.edits import ripple_delete, split_items
    from shotweave.session import materialize

    items = materialize(spark.range(clips).selectExpr(
        "1L as timeline_id", "id + 1 as item_ix", "cast(id as string) as clip_id", "7L as source_id", "id * 48 as source_in", "id * 48 + 47 as source_out",
        "'' as label", "0 as color_index", "cast(array() as array<string>) as group_ids"))
    t = time.time()
    cuts = spark.range(0, clips, 3).selectExpr("1L as timeline_id", "id * 48 + 24 as tl_frame", "cast(id as string) as clip_id")
    split = materialize(split_items(items, cuts))
    ripple_delete(split, split.where(F.pmod(F.col("item_ix") - 1, F.lit(5)) == 0)).write.format("noop").mode("overwrite").save()
    return round(time.time() - t, 3)


def main() -> None:
    from shotweave.queries import load_all
    from shotweave.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(max(int(cpus), 1)), spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        t = time.time()
        registry[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - t

    run("f1_place_items")  # start the executors' code caches
    times = {n: round(run(n), 3) for n in names}
    out = {"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
    if not sys.argv[1:]:
        out["edit_workload"] = {f"clips_{n}": edit_workload(spark, n) for n in (2_000, 2_000_000)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
