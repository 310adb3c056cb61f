"""The accuracy matrix of any number of datasets, as CSV in blocks of columns.

A table of a column per dataset ends at Spark's pivot limit, and long before that its plan and its rows get too wide. Here
the columns are data: a dictionary gives every dataset, in sorted order, a block and a place in it, and each block is a
CSV file of its own with a header. The driver sees no names. A model has a row in the blocks where it has a run.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators.metrics import matrix_cells

COLUMNS = "column STRING, block LONG, place INT"


def _placed(width: int):
    """A function that numbers the sorted names of a task: blocks are in the order of tasks, and of names within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = range(seen, seen + batch.num_rows)
            blocks, places = [first + n // width for n in numbers], [n % width for n in numbers]
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.int64()), pa.array(places, pa.int32())], ["column", "block", "place"])

    return run


def _quoted(value: Column) -> Column:
    """A CSV field as it has to be written."""
    return F.when(value.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def _line(first: Column, *keys: str):
    """Fields of rows (keys, place, field) in the order of their places, after a first one."""

    def lines(rows: DataFrame) -> DataFrame:
        fields = F.sort_array(F.collect_list(F.struct("place", "field")))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(fields, lambda f: f["field"]), ",").alias("_fields")).withColumn(
            "value", F.concat(first, F.lit(","), "_fields")
        )

    return lines


def write_accuracy_blocks(metrics: DataFrame, path: str, width: int = 1000, by_split: bool = False) -> None:
    """The model by dataset matrix at ``path/matrix/block=...``, one CSV file with a header each, null as empty.

    Blocks hold at most ``width`` columns and are numbered in the order of their names; ``path/columns`` says where
    each dataset stands. Every block's rows are sorted by model.
    """
    spark, root = metrics.sparkSession, path.rstrip("/")
    cells = matrix_cells(metrics, by_split)
    names = cells.select("column").distinct().repartitionByRange("column").sortWithinPartitions("column")
    names.mapInArrow(_placed(width), COLUMNS).write.mode("overwrite").parquet(f"{root}/columns")
    columns = spark.read.schema(COLUMNS).parquet(f"{root}/columns")
    # As many fields as the files have: every column of a block for every model that is in the block.
    placed = cells.join(columns, "column")
    present = placed.select("block", "model").distinct().join(columns, "block")
    field = F.coalesce(F.col("accuracy").cast("string"), F.lit(""))
    dense = present.join(cells, ["model", "column"], "left").select("block", "model", "place", field.alias("field"))
    rows = _line(_quoted(F.col("model")), "block", "model")(dense).select("block", F.lit(1).alias("_order"), "model", "value")
    header = _line(F.lit("model"), "block")(columns.select("block", "place", _quoted(F.col("column")).alias("field")))
    lines = rows.unionByName(header.select("block", F.lit(0).alias("_order"), F.lit("").alias("model"), "value"))
    sorted_lines = lines.repartition("block").sortWithinPartitions("block", "_order", "model")
    sorted_lines.select("block", "value").write.mode("overwrite").partitionBy("block").text(f"{root}/matrix")


def read_accuracy_cells(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(model, column, accuracy) of some datasets of a written matrix; only their blocks are read."""
    columns = spark.read.schema(COLUMNS).parquet(f"{path.rstrip('/')}/columns").where(F.col("column").isin(names))
    blocks = sorted({row.block for row in columns.select("block").distinct().collect()})
    found = spark.createDataFrame([], "model STRING, column STRING, accuracy DOUBLE")
    for block in blocks:
        table = spark.read.option("header", True).csv(f"{path.rstrip('/')}/matrix/block={block}")
        long = table.unpivot("model", [F.col(f"`{c}`") for c in table.columns if c in names], "column", "accuracy")
        found = found.unionByName(long.where("accuracy is not null").withColumn("accuracy", F.col("accuracy").cast("double")))
    return found
