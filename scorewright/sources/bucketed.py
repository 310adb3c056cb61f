"""Responses laid out by item key, so that whole rows meet their items without being moved again.

A run's responses are written once and scored often: with other adapters, beside corrected items, for another report.
``write_bucketed`` moves the texts once and keeps them in buckets of a hash of the item key. A join with items on that
key then reads each bucket where it lies; only the items, and of them only what the plan needs, are shuffled.

A bucket is read by one task, and no skew join can split a scan. So the writer counts responses by item, and spreads
the rows of an item that has more than ``hot_rows`` over several buckets by a number, ``item_salt``. Those items and
their numbers are a table of their own, from which the join makes as many copies of just these items.
"""

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorewright.schemas import HOT_ITEMS, ITEM_KEYS

BUCKET_KEYS = (*ITEM_KEYS, "item_salt")


def write_bucketed(responses: DataFrame, path: str, buckets: int, hot_rows: int = 1_000_000) -> None:
    """Responses in so many buckets below ``path``; choose it for parts of a few hundred MB.

    :param hot_rows: responses of one item that may lie in one bucket
    """
    root, keys = path.rstrip("/"), list(ITEM_KEYS)
    responses = responses.withColumn("example_id", F.col("example_id").cast("string"))
    counted = responses.groupBy(*keys).count().where(F.col("count") > hot_rows)
    salts = F.ceil(F.col("count") / hot_rows).cast("int").alias("salts")
    counted.select(*keys, salts).write.mode("overwrite").parquet(f"{root}/hot")
    spark = responses.sparkSession
    hot = spark.read.schema(HOT_ITEMS).parquet(f"{root}/hot")
    # The input partition's number tells equal rows apart, and stays the same when a lost task runs again.
    spread = responses.withColumn("_spread", F.xxhash64(*_hashable(responses), F.spark_partition_id()))
    salted = spread.join(hot, keys, "left")
    salted = salted.withColumn("item_salt", F.coalesce(F.pmod("_spread", "salts").cast("int"), F.lit(0))).drop("_spread", "salts")
    name = f"writing_{uuid.uuid4().hex}"
    # Dealt out by the buckets' own hash, each bucket is one task's and one file.
    writer = salted.repartition(buckets, *BUCKET_KEYS).write.bucketBy(buckets, *BUCKET_KEYS).sortBy(*BUCKET_KEYS)
    writer.option("path", f"{root}/rows").mode("overwrite").format("parquet").saveAsTable(name)
    spark.sql(f"drop table {name}")
    layout = spark.createDataFrame([(buckets, salted.schema.json())], "buckets int, columns string")
    layout.coalesce(1).write.mode("overwrite").json(f"{root}/layout")


def _hashable(table: DataFrame) -> list:
    """Columns whose values tell rows apart; maps have no hash."""
    return [F.col(f"`{f.name}`") for f in table.schema.fields if f.dataType.typeName() != "map"]


def read_bucketed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_bucketed`` wrote: the responses, and the items whose responses lie in several buckets.

    Give both to ``grade`` or ``score``, the second as ``hot_items``.
    """
    root = path.rstrip("/")
    layout = spark.read.schema("buckets int, columns string").json(f"{root}/layout").first()
    schema = StructType.fromJson(json.loads(layout.columns))
    name = "bucketed_" + hashlib.md5(root.encode()).hexdigest()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    keys = ", ".join(f"`{key}`" for key in BUCKET_KEYS)
    # A name in the session's catalog for the files and their layout; dropping it leaves the files.
    spark.sql(f"drop table if exists {name}")
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({keys}) sorted by ({keys}) into {layout.buckets} buckets location '{root}/rows'")
    return spark.table(name), spark.read.schema(HOT_ITEMS).parquet(f"{root}/hot")
