"""Reading benchmark tables and responses."""

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scorewright.operators.adapter import Adapter
from scorewright.operators.benchmarks import get_adapter
from scorewright.schemas import RESPONSES


def read_benchmark(
    spark: SparkSession,
    path: str,
    adapter: Adapter | str | None = None,
    split: str | None = None,
    subset: str | None = None,
) -> DataFrame:
    """Rows of one split of a benchmark, from one subset or from all.

    The table lies in Parquet under ``split=.../subset=...`` folders (in either
    order); both filters then prune folders before any file is opened. The
    adapter, if given, fills in its default split and subset.
    """
    adapter = get_adapter(adapter) if isinstance(adapter, str) else adapter
    if adapter is not None:
        split, subset = split or adapter.split, subset or adapter.subset
    table = spark.read.parquet(path)
    # Folder names stay text, also those that look like numbers.
    as_text = StructType([StructField(f.name, StringType()) if f.name in ("split", "subset") else f for f in table.schema])
    if as_text != table.schema:
        table = spark.read.schema(as_text).parquet(path)
    for name, wanted in (("split", split), ("subset", subset)):
        if wanted is not None:
            table = table.where(F.col(name) == wanted)
    return table


def list_subsets(table: DataFrame, subset: str | None = None) -> DataFrame:
    """The subset given, or all subsets of the table."""
    found = table.select(F.col("subset").cast("string").alias("subset"))
    if subset is not None:
        found = found.where(F.col("subset") == subset)
    return found.distinct()


def list_subset_folders(spark: SparkSession, path: str, split: str | None = None, subset: str | None = None) -> DataFrame:
    """The subset given, or all subsets of a table in ``split=/subset=`` folders (in either order), from folder names alone.

    The file system lists the folders; no file is opened and the plan has no scan. A folder without rows counts too.
    """
    root, jvm = path.rstrip("/"), spark._jvm
    wanted = {"split": "*" if split is None else _escaped(spark, split), "subset": "*" if subset is None else _escaped(spark, subset)}
    names = set()
    for first, second in (("split", "subset"), ("subset", "split")):
        pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/{first}={wanted[first]}/{second}={wanted[second]}")
        for status in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or ():
            if status.isDirectory():
                folder = status.getPath() if second == "subset" else status.getPath().getParent()
                names.add(folder.getName().partition("=")[2])
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return spark.createDataFrame([(None if n == _NO_NAME else unescape(n),) for n in sorted(names)], "subset STRING")


_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _escaped(spark: SparkSession, name: str) -> str:
    """A folder name as Spark writes it, with what means something in patterns quoted."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
    return re.sub(r"([\[\]{}*?,\\])", r"\\\1", escaped)


def tag_subset(table: DataFrame, subset: str) -> DataFrame:
    """Every row marked with its subset."""
    return table.withColumn("subset", F.lit(subset))


def concat_subsets(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The subsets' tables one after the other, each row marked with its subset."""
    tagged = [tag_subset(table, subset) for subset, table in tables.items()]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tagged)


def read_synthetic(spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool = False) -> DataFrame:
    """A synthetic benchmark kept as JSON: one object per line, or one array with ``multi_line``."""
    if not path.endswith(".json"):
        raise ValueError(f"only .json files are supported, not {path}")
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_responses(spark: SparkSession, path: str, format: str = "parquet", partitions: int | None = None) -> DataFrame:
    """Model responses written beforehand; of a list of outputs, the first one counts.

    :param partitions: deal the rows out to so many parts, for few files that cannot be split;
        this shuffles whole texts
    """
    reader = spark.read.format(format)
    if format != "parquet":
        reader = reader.schema(RESPONSES)
    responses = first_output(reader.load(path))
    return responses if partitions is None else responses.repartition(partitions)


def first_output(responses: DataFrame) -> DataFrame:
    """Responses given as a list ``outputs`` of texts reduced to the first text."""
    if "outputs" not in responses.columns:
        return responses
    return responses.withColumn("response", F.get("outputs", F.lit(0))).drop("outputs")
