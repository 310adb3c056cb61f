"""Balanced boxes and busy time against plain Python, also on long input."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from scorewright import grade
from scorewright.functions.extract import balanced_box
from scorewright.operators.benchmarks import MATH_BALANCED_BOXES
from scorewright.operators.metrics import busy_metrics, busy_time
from scorewright.schemas import ITEMS, RESPONSES


def last_box(text):
    """By going through the text character by character."""
    if text is None or "\\boxed{" not in text:
        return None
    rest, depth = text[text.rindex("\\boxed{") + 7 :], 1
    for i, c in enumerate(rest):
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return rest[:i] or None
    return None


def test_balanced_boxes(spark):
    r = random.Random(4)
    texts = [None, "", "\\boxed{}", "\\boxed{1}", "\\boxed{\\frac{1}{2}} end}", "\\boxed{a} \\boxed{{b}", "\\boxed{a\nb}", "}\\boxed{é{}}{"]
    texts += ["".join(r.choice(["\\boxed{", "{", "}", "}", "x", "\n", " é"]) for _ in range(r.randint(1, 25))) for _ in range(1500)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {row.i: row.b for row in frame.select("i", balanced_box(F.col("t")).alias("b")).collect()}
    assert found == {i: last_box(t) for i, t in enumerate(texts)}
    assert sum(v is not None for v in found.values()) > 200


def test_balanced_boxes_of_long_texts(spark):
    """A megabyte of braces in seconds: every piece is looked at once."""
    texts = ["\\boxed{" + "{x}" * 330_000 + "}", "\\boxed{" + "{" * 500_000 + "}" * 500_000 + "}", "\\boxed{" * 140_000, "}" * 1_000_000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    start = time.monotonic()
    found = {row.i: row.n for row in frame.select("i", F.length(balanced_box(F.col("t"))).alias("n")).collect()}
    assert found == {0: 990_000, 1: 1_000_000, 2: None, 3: None}
    assert time.monotonic() - start < 60


def test_grades_with_whole_boxes(spark):
    items = spark.createDataFrame([("1", MATH_BALANCED_BOXES.name, "test", "s", "p", "so \\boxed{\\frac{1}{2}}")], ITEMS)
    rows = [("1", MATH_BALANCED_BOXES.name, "test", m, t, None, None, None) for m, t in (("a", "\\boxed{\\frac{1}{2}}."), ("b", "\\boxed{\\frac{1}{3}}"))]
    found = {r.model: (r.extracted_answer, r.is_correct) for r in grade(items, spark.createDataFrame(rows, RESPONSES), [MATH_BALANCED_BOXES]).collect()}
    assert found == {"a": ("\\frac{1}{2}", True), "b": ("\\frac{1}{3}", False)}


RUNS = "model string, dataset string, split string, is_correct boolean, started_at timestamp, finished_at timestamp"


def union_length(times):
    total, latest = 0, None
    for a, b in sorted(t for t in times if None not in t and t[1] >= t[0]):
        total += max(0, b - max(a, a if latest is None else latest))
        latest = b if latest is None else max(latest, b)
    return total


@pytest.mark.parametrize("bucket", [7, 3600])
def test_busy_time(spark, bucket):
    r, zero = random.Random(9), datetime.datetime(2024, 3, 1)
    at = lambda s: None if s is None else zero + datetime.timedelta(seconds=s)
    times = {m: [(a, a + r.choice([0, 1, 2, 30, -1])) for a in (r.randrange(4000) for _ in range(n))] for m, n in (("a", 300), ("b", 3), ("c", 1))}
    times["a"] += [(None, 5), (5, None), (10_000_000, 10_000_010)]
    rows = [(m, "d", "s", i % 2 == 0, at(a), at(b)) for m, all_times in times.items() for i, (a, b) in enumerate(all_times)]
    frame = spark.createDataFrame(rows, RUNS).repartition(5)
    found = {row.model: row.busy_time for row in busy_time(frame, bucket=bucket).collect()}
    assert found == {m: float(union_length(t)) for m, t in times.items() if any(None not in x and x[1] >= x[0] for x in t)}


def test_busy_metrics_beside_the_others(spark):
    zero = datetime.datetime(2024, 3, 1)
    later = zero + datetime.timedelta(days=3)
    second = datetime.timedelta(seconds=1)
    rows = [("a", "d", "s", True, zero, zero + 4 * second), ("a", "d", "s", False, later, later + 4 * second), ("b", "d", "s", True, None, None)]
    found = {r.model: r for r in busy_metrics(spark.createDataFrame(rows, RUNS)).collect()}
    assert (found["a"].total_time, found["a"].busy_time, found["a"].samples_per_busy_second) == (3 * 86400 + 4, 8.0, 0.25)
    assert found["b"].busy_time is None and found["b"].total_samples == 1
    assert busy_metrics(spark.createDataFrame([], RUNS)).count() == 0
