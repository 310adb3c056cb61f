"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of local cores.
Each query runs twice to warm up and then twice more; the faster time counts. Results go
to Spark's no-op sink, so whole rows are worked out and none is kept.
"""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import all_queries, inputs  # noqa: E402
from catalog.inputs import table  # noqa: E402
from scorewright.session import configured  # noqa: E402

HEADLINE = (
    "mixed_accuracy",
    "result_rows",
    "accuracy_by_model",
    "salted_accuracy",
    "number_answers",
    "math_answers",
    "letter_answers",
    "marker_answers_documents",
    "number_answers_documents",
    "math_answers_documents",
    "items_mmlu",
    "items_gpqa",
    "items_quality",
    "result_logprobs",
    "accuracy_matrix",
    "unanswered_items",
    "generated_accuracy",
    "incremental_rows",
    "bucketed_rows",
    "metrics_of_parts",
    "resumed_answers",
)
# Queries that score every line item once.
SCORING = ("mixed_accuracy", "result_rows", "accuracy_by_model", "salted_accuracy")


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        configured(SparkSession.builder)
        .master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    # The test tables are single files of one row group, which one core would read alone.
    inputs.DEALT = int(cpus)
    timings = {}
    for name in HEADLINE:
        times = [seconds(lambda: known[name].run(spark, folder)) for _ in range(4)]
        timings[name] = round(min(times[2:]), 4)
    responses = table(spark, folder, "lineitem").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "responses": responses,
                "responses_per_second": {name: round(responses / timings[name]) for name in SCORING},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
