"""Headline queries on the bench folder; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, and
``BENCH_QUERIES`` an optional comma-separated subset.

The folder's tables are single files of one row group, which one task reads.
Before the clock starts they are written once more as several files, the form
in which a large table is found; the queries themselves never redistribute
their input.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "s01_atom_scan", "a03_environment_features", "w01_representative_site",
    "a07_field_moments", "g01_tryptophan_component", "j05_burial", "j17_clash_pairs",
    "j08_validate_mutations", "f08_apply_mutations", "w04_candidate_ranking",
    "w09_top_recommendations", "p14_tier_routing", "a16_regression_metrics",
    "w07_cumulative_error", "w12_latest_per_key", "j15_feature_diff",
    "a26_spike_metrics", "m02_fourier_regression",
    "s04_header_id", "j03_nearest_neighbour", "p00_batch_profiles",
)
TABLES = ("supplier", "orders", "lineitem", "events", "embeddings")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE

    from structlake.plans.catalog import load
    from structlake.plans.registry import QUERIES
    from structlake.session import local_session

    load()
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app_name="bench")
    # One small job first, so that start-up is not charged to a query.
    spark.range(1000).selectExpr("sum(id)").collect()
    laid_out = tempfile.mkdtemp(prefix="spark-")
    for table in TABLES:
        spark.read.parquet(f"{folder}/{table}.parquet").repartition(
            spark.sparkContext.defaultParallelism).write.parquet(f"{laid_out}/{table}.parquet")
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, laid_out).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total_seconds",
                      "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
