"""Seconds for each headline query: one warm-up, then the median of three runs into the noop sink.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("voxel_grid", "bbox", "l2_checksum", "triple_cross", "radius_join", "knn_join", "sor_exact", "sor_radius", "ground_split", "ransac_plane", "normals_radius", "euclidean_clusters", "voxel26_clusters", "grid8_clusters", "pipeline_3d_clusters", "pipeline_25d_clusters")
RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pointloom import catalog

    from pointloom.operators import search
    from pointloom.sources import tables

    queries, seconds = catalog.queries(), {}

    def run(f) -> float:
        t = time.perf_counter()
        f(spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    for name in HEADLINE:
        run(queries[name])
        seconds[name] = round(statistics.median(run(queries[name]) for _ in range(RUNS)), 3)
    e = tables.from_embeddings(spark, sf)
    pairs = search.radius_join(e, e, 0.1).count()
    line = {"metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "neighbour_pairs_per_sec": round(pairs / seconds["radius_join"]), "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
