"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from threatlake.plans import load_queries
from threatlake.session import build_session

HEADLINE = [
    "a2_risk_counts", "m1_behaviour6", "w1_port_entropy", "w6_correlated", "w11_sequence_deviation", "w12_reputation_path",
    "j4_latest_log_as_of", "j7_cidr_trusted", "j11_similar_cases", "k7_score_decision", "k8_action_choice", "v1_action_validation",
    "a7_window_metrics", "a12_ip_reputation", "a19_detection_report", "c1_reputation_upsert", "l1_threshold_path", "u3_balanced_sample",
    "m5_isolation_forest", "m6_one_class_svm",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("max(ts)").collect()
    seconds = {}
    for name in HEADLINE:
        if name not in registered:
            continue
        began = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
