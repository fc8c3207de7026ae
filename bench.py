"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query's result is written to the no-op sink, so that all columns are computed. The first
query is run once before, to have the JVM warm; the cold time is reported beside.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = [
    "composite_health",
    "naturalness_score",
    "tone_dimensions",
    "sentence_flags",
    "top_suggestions",
    "redundant_sentences",
    "rule_violations",
    "persona_alignment",
    "compare_turns",
    "embedding_topk",
]


def main() -> None:
    from pyspark.sql import SparkSession

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillmill.plans import registry

    known, times = registry.queries(), {}

    def run(name: str) -> float:
        began = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    cold = run(HEADLINE[0])
    for name in HEADLINE:
        times[name] = run(name)
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    out = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cold_first_query_sec": cold, "documents_per_sec_health": round(docs / max(times[HEADLINE[0]], 1e-9), 1), "cores": cpus,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
