"""Benchmark table to items: prompt and ground truth under a stable key."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorewright import fixed
from scorewright.operators.adapter import Adapter
from scorewright.operators.benchmarks import get_adapter
from scorewright.schemas import ITEMS


def resolved_subset(table: DataFrame) -> Column:
    """The row's subset, else that of its metadata, else ``unknown``."""
    found = []
    if "subset" in table.columns:
        found.append(F.col("subset").cast("string"))
    if "metadata" in table.columns and "subset" in getattr(table.schema["metadata"].dataType, "names", []):
        found.append(F.col("metadata.subset").cast("string"))
    return F.coalesce(*found, F.lit(fixed.UNKNOWN_SUBSET))


# Keys of repeated rows that are sent to all tasks, at most: 40 bytes each.
REPEATED_SENT = 100_000


def with_content_id(table: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Key every row by its content, for tables that bring no key.

    Every row stays: rows of equal content get the content's hash and, from the
    second on, their number among them. Keys depend on content alone, not on any order
    or partitioning of rows.

    A job counts rows by a 128-bit hash of all columns, which is all that it shuffles. Rows
    whose hash is their own, most of a benchmark, get their key where they are. Only repeated
    rows are brought together, counted first within each input partition, and laid out
    again. They are told apart by a list of their hashes that is sent to all tasks, or, where
    there are more than ``REPEATED_SENT``, by a join.

    :param columns: what makes the content; all columns by default. Rows that agree
        on them but differ elsewhere are told apart by the other columns too.
    """
    names = list(columns or table.columns)
    quoted = [F.col(f"`{name}`") for name in table.columns]
    whole = F.md5(F.to_json(F.struct(*quoted), {"ignoreNullFields": "false"}))
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{name}`") for name in names]), {"ignoreNullFields": "false"}))
    key = content if set(names) == set(table.columns) else F.concat_ws("-", content, F.col("_whole"))
    hashed = table.withColumn("_whole", whole)
    repeated = hashed.groupBy("_whole").count().where("count > 1").select("_whole")
    sent = repeated.limit(REPEATED_SENT + 1).collect()
    if not sent:
        return hashed.withColumn("example_id", key).drop("_whole")
    if len(sent) <= REPEATED_SENT:
        repeated = F.broadcast(table.sparkSession.createDataFrame(sent, "_whole string"))
    single = hashed.join(repeated, "_whole", "left_anti").withColumn("example_id", key)
    counted = hashed.join(repeated, "_whole", "left_semi").groupBy("_whole", *quoted).agg(F.count(F.lit(1)).alias("_copies"))
    laid_out = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    numbered = F.when(F.col("_copy") == 1, key).otherwise(F.concat_ws("-", key, F.col("_copy").cast("string")))
    copies = laid_out.withColumn("example_id", numbered)
    return single.unionByName(copies.drop("_copies", "_copy")).drop("_whole")


def _or_error(value: Column, message: str) -> Column:
    key = F.coalesce(F.col("example_id").cast("string"), F.lit("null"))
    return F.coalesce(value, F.raise_error(F.concat(F.lit(message), key)).cast("string"))


def build_items(
    table: DataFrame,
    adapter: Adapter | str,
    example_id: Column | str | None = None,
    split: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Project a benchmark table to items.

    :param table: rows of the benchmark; an ``example_id`` column is its key
    :param adapter: an adapter or a registered dataset name
    :param example_id: the key instead, as a column
    :param split: literal split; else the table's ``split`` column, else the adapter's default
    :param strict: rows that the benchmark's rules cannot express (more options than letters, fewer
        texts than labels, a label outside the benchmark's map, no answer span) are an error; else their
        prompt or truth is null and they count as rows without a truth
    """
    adapter = get_adapter(adapter) if isinstance(adapter, str) else adapter
    if example_id is not None:
        table = table.withColumn("example_id", example_id if isinstance(example_id, Column) else F.col(example_id))
    elif "example_id" not in table.columns:
        table = with_content_id(table)
    for name in adapter.optional:
        # HellaSWAG tells a missing label from a null one, so that column is not filled in.
        if name not in table.columns and name != "label":
            table = table.withColumn(name, F.lit(None).cast(adapter.schema[name].dataType))
    if split is not None:
        split_column = F.lit(split)
    else:
        split_column = F.col("split").cast("string") if "split" in table.columns else F.lit(adapter.split)
    prepared = adapter.prepare(table)
    prompt, truth = adapter.full_prompt(), adapter.truth().cast("string")
    if strict:
        prompt = _or_error(prompt, f"{adapter.name}: no prompt for item ")
        truth = _or_error(truth, f"{adapter.name}: no answer for item ") if adapter.mapped_truth else truth
    return prepared.select(
        F.col("example_id").cast("string").alias("example_id"),
        F.lit(adapter.name).alias("dataset"),
        split_column.alias("split"),
        resolved_subset(table).alias("subset"),
        prompt.alias("prompt"),
        truth.alias("ground_truth"),
    ).to(StructType.fromDDL(ITEMS))
