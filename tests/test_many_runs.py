"""Metrics files whose types conflict, and a matrix of more datasets than a table has columns."""

import csv
import json
from pathlib import Path

from pyspark.sql import functions as F

from scorewright.operators.metrics import accuracy_matrix
from scorewright.plans.aggregate import aggregate_runs
from scorewright.sources.blocks import read_accuracy_cells, write_accuracy_blocks
from scorewright.sources.runs import read_metrics, unreadable_metrics


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_conflicting_types_in_one_job(spark, tmp_path):
    files = {
        "a": {"accuracy": 0, "total_samples": 4, "note": 1, "more": {"seconds": 1, "tags": [1, "x"]}},
        "b": {"accuracy": 0.5, "total_samples": "5", "note": "two", "it's": 7},
        "c": {"accuracy": "0.5", "total_time": 3, "note": None, "flag": True, "more": {"seconds": 2.5}},
        "d": {"accuracy": "high", "total_time": 1e-7, "odd name, \"x\"": [1.5]},
        "e": {"accuracy": None},
    }
    for name, value in files.items():
        write(tmp_path / f"M/{name}_test_metrics.json", value)
    write(tmp_path / "M/twice_test_metrics.json", '{"accuracy": 1, "accuracy": 2}')
    write(tmp_path / "M/list_test_metrics.json", "[1]")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("conflicts", "reading of metrics")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else each stage counts as a job
    try:
        metrics = read_metrics(spark, str(tmp_path))
        assert len(tracker.getJobIdsForGroup("conflicts")) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    kinds = {name: kind for name, kind in metrics.dtypes}
    assert (kinds["accuracy"], kinds["total_samples"], kinds["total_time"], kinds["note"], kinds["flag"]) == ("double", "bigint", "double", "string", "boolean")
    assert kinds["more"] == "struct<seconds:double,tags:array<string>>"
    found = {r.dataset: r for r in metrics.collect()}
    assert {name: r.accuracy for name, r in found.items()} == {"a": 0.0, "b": 0.5, "c": 0.5, "d": None, "e": None}
    assert (found["a"].total_samples, found["b"].total_samples, found["d"].total_time) == (4, 5, 1e-7)
    assert (found["a"].note, found["b"].note, found["c"].note, found["b"]["it's"]) == ("1", "two", None, 7)
    assert found["a"].more.tags == ["1", "x"] and found["c"].more.seconds == 2.5
    assert {r.path.split("/")[-1] for r in unreadable_metrics(spark, str(tmp_path)).collect()} == {"twice_test_metrics.json", "list_test_metrics.json"}


def test_only_whole_numbers(spark, tmp_path):
    write(tmp_path / "M/a_test_metrics.json", {"accuracy": 1, "total_samples": 3})
    write(tmp_path / "M/b_test_metrics.json", {"accuracy": 0})
    wide, matrix = aggregate_runs(spark, str(tmp_path))
    assert dict(wide.dtypes)["accuracy"] == "double" and [tuple(r) for r in matrix.collect()] == [("M", 1.0, 0.0)]


def lines(folder):
    return [row for part in sorted(Path(folder).glob("part-*")) for row in csv.reader(part.read_text().splitlines())]


def test_blocks_hold_the_matrix(spark, tmp_path):
    names = ["a", "b,c", 'd"e', "ü", "x.y", "z"]
    rows = [(f"m{i}", n, s, None if i == 1 else i + k / 10) for i in range(4) for k, n in enumerate(names) for s in ("s", "t") if (i + k) % 3]
    rows += [("m,9", "z", "s", 0.25)]
    metrics = spark.createDataFrame(rows, "model string, dataset string, split string, accuracy double")
    write_accuracy_blocks(metrics, str(tmp_path / "m"), width=2)
    matrix = {(r["model"], n): r[n] for r in accuracy_matrix(metrics).collect() for n in names if r[n] is not None}
    found, headers = {}, []
    for block in sorted((tmp_path / "m/matrix").glob("block=*"), key=lambda p: int(p.name.partition("=")[2])):
        header, *body = lines(block)
        headers += header[1:]
        assert header[0] == "model" and len(header) <= 3 and [r[0] for r in body] == sorted(r[0] for r in body)
        found |= {(row[0], n): float(v) for row in body for n, v in zip(header[1:], row[1:]) if v}
    assert headers == sorted(names) and found == matrix
    cells = {(r.model, r.column): r.accuracy for r in read_accuracy_cells(spark, str(tmp_path / "m"), ["b,c", "z"]).collect()}
    assert cells == {key: v for key, v in matrix.items() if key[1] in ("b,c", "z")}
    write_accuracy_blocks(metrics.limit(0), str(tmp_path / "none"))
    assert read_accuracy_cells(spark, str(tmp_path / "none"), ["z"]).count() == 0


def test_twenty_thousand_datasets(spark, tmp_path):
    """Beyond the pivot limit of 10,000 values."""
    runs = spark.range(60_000).select(
        F.concat(F.lit("m"), F.col("id") % 3).alias("model"), F.format_string("set%05d", F.floor(F.col("id") / 3)).alias("dataset"),
        F.lit("test").alias("split"), (F.col("id") / 60_000).alias("accuracy"))
    write_accuracy_blocks(runs, str(tmp_path / "m"))
    blocks = list((tmp_path / "m/matrix").glob("block=*"))
    assert len(blocks) >= 20
    sizes = [(len(table[0]) - 1, len(table)) for table in map(lines, blocks)]
    assert sum(n for n, _ in sizes) == 20_000 and {rows for _, rows in sizes} == {4} and max(n for n, _ in sizes) <= 1000
    cells = {(r.model, r.column): r.accuracy for r in read_accuracy_cells(spark, str(tmp_path / "m"), ["set00007", "set19999"]).collect()}
    assert cells == {(f"m{i}", f"set{k:05d}"): (3 * k + i) / 60_000 for i in range(3) for k in (7, 19999)}
