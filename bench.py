"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from lodestone.plans import catalog

HEADLINE = (
    "mine_l1_fixed", "mine_l1_multiclass", "mine_l2_fixed", "mine_l3_fixed", "mine_l1_adaptive", "quantile_edges", "pattern_support", "calibration", "auc", "threshold_sweep",
    "drift_psi_kl", "drift_ks", "profile_numeric", "interaction_information", "treatment_aipw", "search_bm25",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.QUERIES["quantile_edges"](spark, folder).collect()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).collect()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
