"""Keys: one result per response key in streams, items that must be unique, keys from content, subsets from folder names."""

import pytest
from pyspark.sql import functions as F

import scorewright.operators.items as items_module
from plans import above_scan, plan_nodes
from scorewright import with_content_id
from scorewright.operators.benchmarks import BBH
from scorewright.operators.score import score
from scorewright.schemas import ITEMS, RESPONSES, RESULTS
from scorewright.sources.benchmark import list_subset_folders, list_subsets, read_benchmark
from scorewright.streaming.incremental import running_accuracy, score_stream, stream_responses


@pytest.fixture()
def tables(spark):
    items = spark.createDataFrame([(str(i), BBH.name, "test", "s", f"prompt {i}", "ABC"[i % 3]) for i in range(12)], ITEMS)
    rows = [(str(i), BBH.name, "test", f"org/m.{j}", f"Answer: {'ABC'[(i + j) % 3]}", None, None, None) for i in range(12) for j in range(2)]
    return items, spark.createDataFrame(rows, RESPONSES)


def plain(frame):
    return sorted(map(str, frame.collect()))


def test_a_file_delivered_twice_adds_nothing(spark, tables, tmp_path):
    items, responses = tables
    arriving, out, checkpoint = (str(tmp_path / name) for name in ("arriving", "out", "checkpoint"))
    first, second = responses.where("model = 'org/m.0'"), responses.where("model = 'org/m.1'")
    # Twice before the first run, twice while the stream is stopped, and beside rows that are new.
    for delivery in ([first, first], [first], [first.unionByName(second)], [second, second]):
        for rows in delivery:
            rows.coalesce(1).write.mode("append").json(arriving)
        stream = stream_responses(spark, arriving, files_per_batch=1)
        score_stream(items, stream, out, checkpoint, [BBH], once_within="10 days").awaitTermination()
    assert plain(spark.read.schema(RESULTS).json(out)) == plain(score(*tables, [BBH]))


def test_repeated_items_end_a_stream(spark, tables, tmp_path):
    items, responses = tables
    responses.write.json(str(tmp_path / "arriving"))
    stream = stream_responses(spark, str(tmp_path / "arriving"))
    twice = items.unionByName(items.where("example_id = '3'").withColumn("ground_truth", F.lit("B")))
    with pytest.raises(ValueError, match="2 items are .*/test/3"):
        score_stream(twice, stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), [BBH])
    with pytest.raises(ValueError, match="2 items"):
        running_accuracy(twice, stream, [BBH])


def test_subsets_from_ten_thousand_folders(spark, tmp_path):
    root = tmp_path / "many"
    for i in range(10_000):
        (root / f"split={'test' if i % 4 else 'train'}" / f"subset=s{i}").mkdir(parents=True)
    found = list_subset_folders(spark, str(root))
    assert found.count() == 10_000
    assert not [text for text, _ in plan_nodes(found) if "FileScan" in text]
    assert {r.subset for r in list_subset_folders(spark, str(root), split="train").collect()} == {f"s{i}" for i in range(0, 10_000, 4)}
    assert [r.subset for r in list_subset_folders(spark, str(root), subset="s17").collect()] == ["s17"]
    assert list_subset_folders(spark, str(root), subset="none").count() == 0
    assert list_subset_folders(spark, str(tmp_path / "no such folder")).count() == 0


@pytest.mark.parametrize("order", [("split", "subset"), ("subset", "split")])
def test_folder_names_are_read_as_spark_writes_them(spark, tmp_path, order):
    names = ["a b", "c/d", "e=f", "100%", "{x,y}", "[z]*", "ü", None]
    rows = spark.createDataFrame([(i, "q", "t", "test" if i % 2 else "train", n) for i, n in enumerate(names * 2 + ["only train", "x"])],
                                 "id long, input string, target string, split string, subset string")
    rows.write.partitionBy(*order).parquet(str(tmp_path / "b"))
    table = read_benchmark(spark, str(tmp_path / "b"))
    assert plain(list_subset_folders(spark, str(tmp_path / "b"))) == plain(list_subsets(table))
    for name in names[:-1]:
        assert [r.subset for r in list_subset_folders(spark, str(tmp_path / "b"), subset=name).collect()] == [name]
    assert plain(list_subset_folders(spark, str(tmp_path / "b"), split="train")) == plain(list_subsets(table.where("split = 'train'")))


def content_table(spark):
    rows = [(f"question {i % 60}", "x" if i < 60 else "y", i % 7 if i < 90 else 0) for i in range(150)] + [("same", None, None)] * 5
    return spark.createDataFrame(rows, "input string, target string, level int")


def test_content_keys_number_repeated_rows(spark, monkeypatch):
    table = content_table(spark)
    keyed = with_content_id(table)
    assert plain(keyed.drop("example_id")) == plain(table)
    ids = [r.example_id for r in keyed.collect()]
    assert len(set(ids)) == len(ids)
    same = sorted(r.example_id for r in keyed.where("input = 'same'").collect())
    assert same == [same[0]] + [f"{same[0]}-{i}" for i in range(2, 6)]
    assert plain(with_content_id(table.repartition(5))) == plain(keyed)
    # With more repeated rows than are sent to the tasks, keys are the same.
    monkeypatch.setattr(items_module, "REPEATED_SENT", 0)
    assert plain(with_content_id(table)) == plain(keyed)


def test_content_keys_move_hashes_only(spark, tmp_path):
    content_table(spark).write.parquet(str(tmp_path / "t"))
    keyed = with_content_id(spark.read.parquet(str(tmp_path / "t")))
    # The branch of single rows is the first; from its scan to the join nothing is exchanged.
    path = above_scan(keyed, "FileScan parquet .*input")
    assert "Join" in path[0] and "Exchange" not in path, path
    single = spark.read.parquet(str(tmp_path / "t")).dropDuplicates()
    single.write.parquet(str(tmp_path / "single"))
    assert not [text for text, _ in plan_nodes(with_content_id(spark.read.parquet(str(tmp_path / "single")))) if "Exchange" in text]
