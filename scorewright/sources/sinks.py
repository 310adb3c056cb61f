"""Writing results, metrics and reports. Every sink writes in parallel, one folder per table."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.text import dataset_label, model_label
from scorewright.operators.metrics import accuracy_matrix, wide_metrics
from scorewright.schemas import NAME_MARK, RUN_KEYS


def run_paths(output_dir: str, model: str, dataset: str, split: str) -> dict[str, str]:
    """Where one run's results, full results and metrics go."""
    model_name = model.split("/")[-1]
    dataset_name = dataset.split("/")[-1].split(".")[0]
    stem = f"{output_dir.rstrip('/')}/{model_name}/{dataset_name}_{split}"
    return {"rows": f"{stem}.jsonl", "all": f"{stem}_all.json", "metrics": f"{stem}_metrics.json"}


def append_rows(results: DataFrame, path: str, compression: str = "none") -> None:
    """Append result rows as JSON lines, nulls kept.

    Names of columns, model and dataset stand in every line; a ``compression`` such as ``gzip`` takes most of that away.
    A file is then read by one task.
    """
    results.write.mode("append").option("ignoreNullFields", False).option("compression", compression).json(path)


def write_by_run(results: DataFrame, path: str, format: str = "parquet", mode: str = "append") -> None:
    """Add result rows under one folder per run, by the runs' short names.

    Rows are brought together by run first, so that a run makes few files; adaptive
    execution splits a run that is too large for one task. This costs a shuffle of
    the whole rows, for readers that want single runs.
    """
    named = results.withColumns(
        {"model": model_label(F.col("metadata.model")), "dataset": dataset_label(F.col("metadata.dataset"))}
    )
    writer = named.hint("rebalance", *RUN_KEYS).write.mode(mode).format(format)
    writer.option("ignoreNullFields", False).partitionBy(*RUN_KEYS).save(path)


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One JSON array per partition, an element a line; the last line is held back for its comma."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(0)
        before = pa.array(["[" if held is None else held + ","], rows.type)
        lines = pa.concat_arrays([before, pc.binary_join_element_wise(rows.slice(0, len(rows) - 1), pa.scalar(",", rows.type), "")])
        held = rows[-1].as_py()
        yield pa.RecordBatch.from_arrays([lines], ["value"])
    if held is not None:
        yield pa.RecordBatch.from_pydict({"value": pa.array([held, "]"], pa.string())})


def write_arrays(results: DataFrame, path: str, compression: str = "none") -> None:
    """Replace the full result set: JSON arrays, one in each part file.

    Read back with ``multiLine``. One array in one file would put all rows through
    one task. For ``compression`` see :func:`append_rows`.
    """
    rows = results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(_array_lines, "value STRING").write.mode("overwrite").option("compression", compression).text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON, one file per run at ``{path}/model={model}/run={dataset}_{split}_metrics.json``.

    Folders have the short names of :func:`run_paths`; a name that is cut short carries a
    mark of the full one, so that two models (or datasets) of one short name do not meet.
    The full names are in the file as ``model_id`` and ``dataset_id``. A run that is there
    already is replaced; other runs in the folder stay.
    """

    def folder(name: Column, short: Column) -> Column:
        return F.when(name == short, short).otherwise(F.concat(short, F.lit(NAME_MARK), F.left(F.md5(name), F.lit(8))))

    model, dataset = F.col("model"), F.col("dataset")
    run = F.concat_ws("_", folder(dataset, dataset_label(dataset)), "split", F.lit("metrics.json"))
    named = metrics.withColumns({"model_id": model, "dataset_id": dataset, "run": run, "model": folder(model, model_label(model))})
    named = named.drop("dataset", "split").repartition("model", "run")
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("ignoreNullFields", False).partitionBy("model", "run").json(path)


def write_states(states: DataFrame, path: str, part: str) -> None:
    """Counts and times of one part of runs, in the place of what was saved under its name."""
    states.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={part}")


def _write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_wide_metrics(metrics: DataFrame, path: str) -> None:
    """The wide metrics table as CSV with a header, null as empty."""
    _write_csv(wide_metrics(metrics), path)


def write_accuracy_matrix(metrics: DataFrame, path: str, datasets: list[str] | None = None) -> None:
    """The model by dataset matrix as CSV with a header, null as empty."""
    _write_csv(accuracy_matrix(metrics, datasets), path)
