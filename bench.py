"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from lexigrid.operators.index import WordIndex  # noqa: E402
from lexigrid.plans.registry import QUERIES, dictionary  # noqa: E402

HEADLINE = ("fuzzy_topk", "fuzzy_topk_trie", "fuzzy_topk_batch", "trie_nodes", "trie_descendants", "dictionary_distinct", "bench_mean", "bench_speedup")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map={"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["fuzzy_topk"](spark, sf_dir).count()  # starts the Python workers and keeps an index
    began = time.perf_counter()
    WordIndex.build(dictionary(spark, sf_dir))
    took = {"index_build": round(time.perf_counter() - began, 3)}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
