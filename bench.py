"""Timings of the headline queries: prints one JSON line.

``build`` is the whole batch job with fitted models (customer table, preparation, six fits, own
explanations, segments, tiers, reasons, store).  ``stand_in_store`` builds the store with closed-form
scores that the other entries read: queries as served to a dashboard, after one warm-up round.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["g05_compute_metrics", "j03_choose_tiers", "j08_campaign_table", "j09_tier_summary",
            "j16_kpis", "j17_filter_options", "j18_risk_histogram", "j20_segments",
            "j21_weighted_quantiles", "j22_heatmap", "j23_drivers", "j24_segment_profiles",
            "j25_simulate_campaign", "j30_list_customers", "j31_get_customer", "h13_waterfall",
            "a06_export_customers", "c01_describe_numeric", "c07_churn_rate_table",
            "c11_spearman_matrix", "d01_mann_whitney", "d02_chi2_cramers_v", "b06_coherence_report",
            "b13_outlier_summary", "e11_build_features", "f02_segment_rate_scores",
            "i01_segmentation_prepare", "k02_number_fidelity", "k03_sensitive_terms"]
MODELS = ["f04_logreg_simple", "f06_decision_tree"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from catalog import load_all
    from catalog.registry import QUERIES
    from loyaltide.plans.score_table import build_store, load_store
    from loyaltide.sources.customer_base import load_customer_base
    load_all()

    def run(name: str) -> float:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        return round(time.perf_counter() - t, 3)

    times: dict[str, float] = {}
    t = time.perf_counter()
    build_store(load_customer_base(spark, sf_dir))
    times["build"] = round(time.perf_counter() - t, 3)
    t = time.perf_counter()
    load_store(spark, sf_dir)
    times["stand_in_store"] = round(time.perf_counter() - t, 3)
    for name in HEADLINE:
        first = run(name)
        times[name] = min(first, run(name))
    for name in MODELS:
        times[name] = run(name)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
