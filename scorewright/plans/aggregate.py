"""Aggregation job: the metrics files of many runs to a wide table and an accuracy matrix."""

from pyspark.sql import DataFrame, SparkSession

from scorewright.operators.metrics import accuracy_matrix, distinct_names, wide_metrics
from scorewright.sources.runs import read_metrics
from scorewright.sources.sinks import write_accuracy_matrix, write_wide_metrics


def aggregate_runs(
    spark: SparkSession, results_dir: str, output_dir: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both reports over all runs below ``results_dir``; also written as CSV with ``output_dir``.

    ``results_dir`` is a folder of metrics files, or what :func:`evaluate` wrote to. Models
    and datasets of one short name appear under their full names. Without any run both
    reports have a header only; ``unreadable_metrics`` names the files that were left out.
    """
    metrics = distinct_names(read_metrics(spark, results_dir))
    if output_dir is not None:
        write_wide_metrics(metrics, f"{output_dir.rstrip('/')}/aggregated_metrics")
        write_accuracy_matrix(metrics, f"{output_dir.rstrip('/')}/acc_results")
    return wide_metrics(metrics), accuracy_matrix(metrics)
