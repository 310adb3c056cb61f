"""Metrics of evaluation runs, and what is made of many runs' metrics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.schemas import RUN_KEYS


def accuracy(is_correct: Column) -> Column:
    """Share of true rows among all rows, null ones included; 0 without rows."""
    return F.coalesce(F.try_divide(F.count_if(is_correct), F.count(F.lit(1))), F.lit(0.0))


def elapsed_seconds(started_at: Column, finished_at: Column) -> Column:
    """Seconds from the first start to the last finish."""
    first, last = F.min(started_at.cast("timestamp")), F.max(finished_at.cast("timestamp"))
    return (F.unix_micros(last) - F.unix_micros(first)) / F.lit(1e6)


def run_metrics(graded: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Sample count, accuracy and throughput of every run.

    Takes graded rows or results. Throughput is null without response times. All
    of it is partial aggregation: one row per run and input partition is shuffled,
    however large one run may be.
    """
    if "metadata" in graded.columns:
        for name in ("dataset", "model", "subset"):
            graded = graded.withColumn(name, F.col(f"metadata.{name}"))
    if {"started_at", "finished_at"} <= set(graded.columns):
        seconds = elapsed_seconds(F.col("started_at"), F.col("finished_at"))
    else:
        seconds = F.max(F.lit(None).cast("double"))
    totals = graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_samples"),
        accuracy(F.col("is_correct")).alias("accuracy"),
        seconds.alias("total_time"),
    )
    speed = F.try_divide(F.col("total_samples"), F.col("total_time"))
    return totals.withColumn("samples_per_second", speed)


def busy_time(responses: DataFrame, keys: Sequence[str] = RUN_KEYS, bucket: int = 3600) -> DataFrame:
    """Seconds, by run, in which at least one response was being made: ``busy_time``.

    The lengths of the union of all times from ``started_at`` to ``finished_at``, so gaps between parts of a run
    don't count and overlapping responses count once. In the order of starts, each time adds what of it lies after
    the latest finish so far. Times are first merged within buckets of so many seconds of their starts, in as many
    tasks as there are; only merged times, few in a bucket, are gone through by run. Rows without both times, or that
    finish before they start, count for nothing.
    """
    times = responses.select(
        *keys, F.unix_micros(F.col("started_at").cast("timestamp")).alias("_from"), F.unix_micros(F.col("finished_at").cast("timestamp")).alias("_to")
    )
    times = times.where("_to >= _from").withColumn("_bucket", F.floor(F.col("_from") / (bucket * 1_000_000)))
    # Millions of responses may start in one bucket of a large run; those of one start are one time.
    times = times.groupBy(*keys, "_bucket", "_from").agg(F.max("_to").alias("_to"))

    def latest(*parts: str) -> Column:
        before = Window.partitionBy(*parts).orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
        return F.max("_to").over(before)

    inside = Window.partitionBy(*keys, "_bucket").orderBy("_from")
    fresh = F.coalesce((F.col("_from") > F.col("_latest")).cast("int"), F.lit(1))
    numbered = times.withColumn("_latest", latest(*keys, "_bucket")).withColumn("_island", F.sum(fresh).over(inside))
    merged = numbered.groupBy(*keys, "_bucket", "_island").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    added = F.col("_to") - F.greatest(F.col("_from"), F.coalesce("_latest", "_from"))
    merged = merged.withColumn("_latest", latest(*keys))
    return merged.groupBy(*keys).agg((F.sum(F.greatest(added, F.lit(0).cast("long"))) / F.lit(1e6)).alias("busy_time"))


def busy_metrics(graded: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """:func:`run_metrics` with ``busy_time`` and ``samples_per_busy_second`` beside the time from first to last."""
    busy = busy_time(graded, keys)
    joined = run_metrics(graded, keys).join(busy, list(keys), "left")
    return joined.withColumn("samples_per_busy_second", F.try_divide(F.col("total_samples"), F.col("busy_time")))


def metric_states(graded: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """What metrics are made of, one row per run: counts, first start and last finish. States of parts of a run merge."""
    if "metadata" in graded.columns:
        for name in ("dataset", "model", "subset"):
            graded = graded.withColumn(name, F.col(f"metadata.{name}"))

    def time(name: str) -> Column:
        return F.col(name).cast("timestamp") if name in graded.columns else F.lit(None).cast("timestamp")

    return graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if("is_correct").alias("correct_samples"),
        F.min(time("started_at")).alias("first_start"),
        F.max(time("finished_at")).alias("last_finish"),
    )


def merged_metrics(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Metrics of runs from the states of all their parts, as :func:`run_metrics` gives them for a whole run."""
    merged = states.groupBy(*keys).agg(
        F.sum("total_samples").alias("total_samples"),
        F.sum("correct_samples").alias("_correct"),
        elapsed_seconds(F.col("first_start"), F.col("last_finish")).alias("total_time"),
    )
    share = F.coalesce(F.try_divide(F.col("_correct").cast("double"), F.col("total_samples")), F.lit(0.0))
    speed = F.try_divide(F.col("total_samples"), F.col("total_time"))
    return merged.select(*keys, "total_samples", share.alias("accuracy"), "total_time", speed.alias("samples_per_second"))


def merge_metrics(runs: Sequence[DataFrame]) -> DataFrame:
    """Metrics tables of different columns as one, with null where a column is missing."""
    first, *others = runs
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def wide_columns(names: Sequence[str]) -> list[str]:
    """Column order of the wide table: model, accuracy, other metrics by name, dataset, split."""
    others = sorted(set(names) - {"model", "accuracy", "dataset", "split"})
    return ["model", "accuracy", *others, "dataset", "split"]


def wide_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics of all runs with their columns in the order of the report."""
    if "accuracy" not in metrics.columns:
        metrics = metrics.withColumn("accuracy", F.lit(None).cast("double"))
    return metrics.select(*[F.col(f"`{name}`") for name in wide_columns(metrics.columns)])


def distinct_names(metrics: DataFrame) -> DataFrame:
    """Metrics whose short names tell runs apart: where two full names share a short one, the full ones.

    Full names are in ``model_id`` and ``dataset_id``; without them nothing changes.
    """
    for name in ("model", "dataset"):
        full = f"{name}_id"
        if full not in metrics.columns:
            continue
        shared = metrics.groupBy(name).agg(F.count_distinct(full).alias("_full")).where("_full > 1").drop("_full")
        metrics = metrics.join(shared.withColumn("_shared", F.lit(True)), name, "left")
        metrics = metrics.withColumn(name, F.when(F.col("_shared"), F.coalesce(full, name)).otherwise(F.col(name))).drop("_shared")
    return metrics


def distinct_sorted(metrics: DataFrame, column: str) -> DataFrame:
    """The sorted models, or datasets, that have a run."""
    return metrics.select(column).distinct().orderBy(column)


def matrix_cells(metrics: DataFrame, by_split: bool = False) -> DataFrame:
    """Accuracy by ``model`` and ``column`` (a dataset, or a dataset's split), one row for each that has a run.

    A run without accuracy counts as 0; of several splits of a dataset the last by name counts.
    """
    if "accuracy" not in metrics.columns:
        metrics = metrics.withColumn("accuracy", F.lit(None).cast("double"))
    name = F.concat_ws("_", "dataset", "split") if by_split else F.col("dataset")
    cells = metrics.select(
        "model", name.alias("column"), "split", F.coalesce(F.col("accuracy"), F.lit(0.0)).alias("accuracy")
    )
    return cells.groupBy("model", "column").agg(F.max_by("accuracy", "split").alias("accuracy"))


def accuracy_matrix(
    metrics: DataFrame, datasets: Sequence[str] | None = None, by_split: bool = False
) -> DataFrame:
    """Accuracy by model (rows, sorted) and dataset (columns, sorted).

    A run without accuracy counts as 0, a run that does not exist is null. Of
    several splits of a dataset the last by name counts; ``by_split`` gives each
    its own column instead.

    A table has as many columns as Spark's pivot limit allows; ``write_accuracy_blocks`` has no such limit.

    :param datasets: the dataset columns, if known; else a job finds them
    """
    columns = None if datasets is None else sorted(datasets)
    pivoted = matrix_cells(metrics, by_split).groupBy("model").pivot("column", columns).agg(F.first("accuracy"))
    return pivoted.orderBy("model")
