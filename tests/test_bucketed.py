"""Responses in buckets: the same results without moving them."""

import pytest

from plans import above_scan
from scorewright.operators.benchmarks import BBH
from scorewright.operators.score import score
from scorewright.schemas import ITEMS, RESPONSES
from scorewright.sources.bucketed import read_bucketed, write_bucketed


@pytest.fixture()
def tables(spark):
    items = spark.createDataFrame([(str(i), BBH.name, "test", "s", f"prompt {i}", "ABC"[i % 3]) for i in range(40)], ITEMS)
    # Item 7 has most of the responses, some of them equal rows; item 99 is not there.
    rows = [(str(i), BBH.name, "test", f"org/m.{j}", f"Answer: {'ABC'[(i + j) % 3]}", None, None, None) for i in range(40) for j in range(3)]
    rows += [("7", BBH.name, "test", f"org/n.{j % 50}", "Answer: B", None, None, None) for j in range(400)]
    rows += [("99", BBH.name, "test", "org/m.0", "Answer: A", None, None, None), ("8", BBH.name, "test", "org/m.0", None, None, None, None)]
    return items, spark.createDataFrame(rows, RESPONSES).repartition(3)


def plain(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("unmatched", ["drop", "keep"])
def test_same_rows(spark, tables, tmp_path, unmatched):
    items, responses = tables
    write_bucketed(responses, str(tmp_path / "b"), 4, hot_rows=100)
    bucketed, hot = read_bucketed(spark, str(tmp_path / "b"))
    assert [(r.example_id, r.salts) for r in hot.collect()] == [("7", 5)]
    spread = bucketed.where("example_id = '7'").groupBy("item_salt").count().collect()
    assert len(spread) == 5 and max(r["count"] for r in spread) < 200
    assert plain(score(items, bucketed, [BBH], unmatched=unmatched, hot_items=hot)) == plain(score(items, responses, [BBH], unmatched=unmatched))
    with pytest.raises(ValueError, match="salts already"):
        score(items, bucketed, [BBH], salt=2, hot_items=hot)


def test_responses_are_not_moved(spark, tables, tmp_path):
    items, responses = tables
    write_bucketed(responses, str(tmp_path / "b"), 4)
    bucketed, hot = read_bucketed(spark, str(tmp_path / "b"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = above_scan(score(items, bucketed, [BBH], hot_items=hot), r"FileScan parquet .*bucketed_")
        assert "Join" in path[0] and "Exchange" not in path, path
        # Without buckets the same texts are exchanged.
        responses.write.parquet(str(tmp_path / "plain"))
        path = above_scan(score(items, spark.read.parquet(str(tmp_path / "plain")), [BBH]), "FileScan parquet .*response#")
        assert "Join" in path[0] and "Exchange" in path, path
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_written_again_and_empty(spark, tables, tmp_path):
    items, responses = tables
    write_bucketed(responses, str(tmp_path / "b"), 4)
    write_bucketed(responses.where("model = 'org/m.1'"), str(tmp_path / "b"), 2)
    bucketed, hot = read_bucketed(spark, str(tmp_path / "b"))
    assert bucketed.count() == 40 and hot.count() == 0
    write_bucketed(responses.limit(0), str(tmp_path / "b"), 2)
    assert read_bucketed(spark, str(tmp_path / "b"))[0].count() == 0
