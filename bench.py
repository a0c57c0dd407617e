"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python call site of every column more than doubles the time to build a wide plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workloads():
    from catalog import registered as r
    from factorloom.operators import factors, library

    def seeds_daily(spark, folder):
        return factors.compute_factors(r.daily(spark, folder), library.seed_list())

    def composed_daily(spark, folder):
        return factors.compute_factors(r.daily(spark, folder), list(r.COMPOSED_SET.values()))

    yield "composed_set_daily", composed_daily
    yield "seed_batch_daily", seeds_daily
    names = (
        "P4_vwap_cross_section", "T2_ts_mean_sparse", "T4_correl_sparse", "X1_rank_daily",
        "J1_densify_daily", "A031", "K2_factor_gram", "K4_select_exemplars", "C1_initial_chains",
        "C3_match_chain", "L4_validate_candidates", "L6_parse_documents", "L7_prompt_context",
        "K3_planted_embeddings", "K5_similarity_embeddings", "B1_named_batch", "L8_append_candidates",
    )
    for name in names:
        yield name, r.QUERIES[name]


def main() -> None:
    spark = session()
    spark.range(1).count()
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    times = {}
    for name, build in workloads():
        start = time.time()
        build(spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
