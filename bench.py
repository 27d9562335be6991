"""Runs the headline queries and prints one line of JSON: BENCH_SF_DIR names the tables, BENCH_CPUS the cores."""

from __future__ import annotations

import json
import os
import sys
import time

from cairn.plans import queries as plans
from cairn.session import session

HEADLINE = [
    "raster_min", "raster_hqs", "raster_resolve_window", "raster_culled_lod", "raster_overdraw", "batch_bbox", "batch_cull", "morton_order", "chain_delta", "delta_histogram",
    "delta_good_points", "octree_leaves", "voxel_count", "lod_per_cell", "quantize_10_10_10", "codec_roundtrip"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus, **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    took = {}
    for name in sys.argv[1:] or [q for q in HEADLINE if q in plans.QUERIES]:
        run = lambda: plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        if not took:
            run()  # starts workers and compiles what all queries share
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
