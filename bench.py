"""Headline queries, timed; prints one JSON line.

Each query runs once before the clock to load classes and once measured; what is measured covers
building the plan, running it and fetching the result, at the data in ``$BENCH_SF_DIR``.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from workload.queries import QUERIES

HEADLINE = [
    "gene_monogenic",
    "gene_monogenic_compat",
    "gene_monogenic_rare",
    "gene_ttest",
    "gene_count_difference",
    "variant_monogenic",
    "variant_monogenic_all",
    "variant_case_exclusive",
    "gene_digenic",
    "gene_digenic_dense",
    "variant_digenic",
    "variant_digenic_dense",
    "ntests",
    "ranked_positions",
    "variant_frequency",
    "recurrent_blacklist",
    "phenotype_to_calls",
    "browse_variants",
    "drilldown_ranking",
    "pivot_totals",
    "calls_parquet",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf_dir).collect()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
