"""Times the headline queries; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from kilnlog.plans import catalog

HEADLINE = ["scan_lines", "split_cycles", "milestone_hits", "baseline_train", "anomalies_all", "anomaly_context", "otel_traces", "process_stats", "chunk_chars", "chunk_lines", "bm25_topk", "vector_topk", "quant_topk", "hybrid_rrf", "template_counts", "search_logs"]


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
