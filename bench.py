"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from folioscope.plans import registry

NAMES = ("hybrid_search", "rerank_fusion", "pool_documents", "checksum_dedupe", "snapshot_diff", "list_documents", "inspect_documents",
         "transcript_metadata", "recency_scores", "evaluation", "chunked_documents", "page_texts")

#: Queries that take longer are timed once.
SHORT = 5.0


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    began = time.time()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, "question_terms", sf_dir)  # start-up is nobody's time
    cold, warm = {}, {}
    for name in NAMES:
        cold[name] = round(seconds(spark, name, sf_dir), 3)
        # the median of three warm runs where a run is short, else the one run
        warm[name] = round(median(seconds(spark, name, sf_dir) for _ in range(3)), 3) if cold[name] < SHORT else cold[name]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
