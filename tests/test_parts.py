"""Runs in parts: metrics that add up, and answers that go on where a run has stopped."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from scorewright.operators.benchmarks import BBH
from scorewright.operators.metrics import merged_metrics, metric_states, run_metrics
from scorewright.operators.score import grade
from scorewright.plans.aggregate import aggregate_runs
from scorewright.plans.evaluate import evaluate
from scorewright.schemas import ITEMS, RESPONSES
from scorewright.sources.runs import read_run_metrics
from scorewright.streaming.answers import answer_stream, stage_items, unasked


def at(second):
    return datetime.datetime(2024, 1, 1, 0, 0, second)


@pytest.fixture()
def tables(spark):
    items = spark.createDataFrame(
        [(str(i), BBH.name, "test", "s", f"prompt {i}", "ABC"[i % 3] if i % 4 else None) for i in range(24)], ITEMS
    )
    responses = spark.createDataFrame(
        [(str(i), BBH.name, "test", f"org/m.{j}", f"Answer: {'ABC'[(i + j) % 3]}", None, at(i), at(i + 2 + j)) for i in range(24) for j in range(2)],
        RESPONSES,
    )
    return items, responses


def plain(frame):
    return sorted(map(str, frame.collect()))


def test_states_merge_to_the_metrics_of_the_whole(spark, tables):
    graded = grade(*tables, [BBH])
    parts = [graded.where(f"pmod(cast(example_id as int), 3) = {i}") for i in range(3)]
    states = metric_states(parts[0]).unionByName(metric_states(parts[1])).unionByName(metric_states(parts[2]))
    assert plain(merged_metrics(states)) == plain(run_metrics(graded))
    # Without times, throughput is null; without rows there is no run.
    timeless = graded.drop("started_at", "finished_at")
    assert plain(merged_metrics(metric_states(timeless))) == plain(run_metrics(timeless))
    assert merged_metrics(metric_states(graded.limit(0))).count() == 0


@pytest.mark.parametrize("by_run", [False, True])
def test_parts_add_up_and_repeats_change_nothing(spark, tables, tmp_path, by_run):
    items, responses = tables
    early, late = responses.where("cast(example_id as int) < 10"), responses.where("cast(example_id as int) >= 10")
    whole = run_metrics(grade(items, responses, [BBH]))
    evaluate(items, early, str(tmp_path), [BBH], part="early", by_run=by_run)
    assert {r.total_samples for r in read_run_metrics(spark, str(tmp_path)).collect()} == {10}
    for _ in range(2):
        found = evaluate(items, late, str(tmp_path), [BBH], part="late", by_run=by_run)
        assert plain(found) == plain(whole)
        assert {(r.model, r.total_samples) for r in read_run_metrics(spark, str(tmp_path)).collect()} == {("org/m.0", 24), ("org/m.1", 24)}
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "rows")).count() == 48
    # A part of one run leaves the other run's metrics as they are.
    evaluate(items, responses.where("model = 'org/m.0'").limit(5), str(tmp_path), [BBH], part="more", by_run=by_run)
    wide, _ = aggregate_runs(spark, str(tmp_path))
    assert {(r.model, r.total_samples) for r in wide.collect()} == {("m.0", 29), ("m.1", 24)}
    with pytest.raises(ValueError, match="part's name"):
        evaluate(items, early, str(tmp_path), [BBH], part="a/b")


def counted(log, stop_at=None):
    """A model that writes down every prompt it is asked, and may stop working at one."""
    log = str(log)

    def load():
        def model(prompts):
            with open(log, "a", encoding="utf-8") as asked:
                for prompt in prompts:
                    if stop_at is not None and prompt == stop_at:
                        raise RuntimeError("out of memory")
                    asked.write(prompt + "\n")
            return [f"Answer to {prompt}" for prompt in prompts]

        return model

    return load


def test_a_killed_run_goes_on(spark, tables, tmp_path):
    items = tables[0]
    staged, path, log = str(tmp_path / "staged"), str(tmp_path / "answers"), tmp_path / "asked.txt"
    # Six files of four items, one after the other; the fourth one is where the model stops, at its first prompt.
    for k in range(6):
        stage_items(items.where(f"cast(example_id as int) div 4 = {k}").coalesce(1).sortWithinPartitions(F.col("example_id").cast("int")), staged)
    start = lambda model, checkpoint, **more: answer_stream(
        spark, staged, "org/m", model, path, str(tmp_path / checkpoint), **more
    )
    with pytest.raises(StreamingQueryException):
        start(counted(log, stop_at="prompt 12"), "one", batch_size=1).awaitTermination()
    first = log.read_text().splitlines()
    saved = {f"prompt {r.example_id}" for r in spark.read.schema(RESPONSES).parquet(path).collect()}
    assert {f"prompt {i}" for i in range(12)} <= saved <= set(first) and "prompt 12" not in saved
    assert unasked(items, path, "org/m").count() == 24 - len(saved)
    # Go on with the checkpoint; then with none, as after a kill between saving and recording; then with nothing to do.
    for checkpoint in ("one", "two", "two"):
        start(counted(log), checkpoint, files_per_piece=4).awaitTermination()
        later = log.read_text().splitlines()[len(first) :]
        assert sorted(later) == sorted({f"prompt {i}" for i in range(24)} - saved), "nothing that was saved is asked again"
    answers = spark.read.schema(RESPONSES).parquet(path)
    assert {(r.example_id, r.response) for r in answers.collect()} == {(str(i), f"Answer to prompt {i}") for i in range(24)} and answers.count() == 24
    asked = len(log.read_text().splitlines())
    # Another model has all to answer; items staged twice are asked once.
    stage_items(items, staged)
    answer_stream(spark, staged, "org/n", counted(log), path, str(tmp_path / "three"), files_per_piece=100).awaitTermination()
    assert len(log.read_text().splitlines()) == asked + 24
