"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "A_site_audit", "P20_page_snapshot", "P15_links", "P21_resource_discovery", "R_page_rule_findings", "R1_duplicate_groups",
    "R_site_rule_findings", "C3_area_scores", "C6_score_profiles", "J15_queue_order", "J13_search_opportunity",
    "J18_template_heatmap", "F1_nearest_rank_percentile", "F2_document_timings", "F14_search_top_queries", "G1_crawl_depth",
    "G4_link_opportunities", "I3_tech_signals", "I8_route_templates", "B2_run_comparison", "B5_portfolio", "X2_private_references",
    "X4_redact_text", "V6_citation_support", "E1_hourly_vitals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.auditlake.inputPartitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from auditlake.plans import all_queries  # noqa: F401
    from auditlake.plans.registry import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
