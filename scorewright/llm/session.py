"""Helpers around the session: shared folders, checkpoints, partition counts, Arrow output."""

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle by key has. Given to repartition(), it keeps small rows with much work in many tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only a local session without that setting gets a temporary folder; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return folder.rstrip("/")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a table of our own that nothing reads any more, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(frame: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """The frame from a checkpoint in the shared folder.

    :param drop_shuffles: files of the shuffles before it go as soon as it is there, instead of staying on disk for the
        whole session; what is made of the frame itself later shuffles anew
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    if not drop_shuffles:
        return frame.checkpoint(eager=True)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        # The setting holds for frames made under it.
        return frame.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key, as long, and the text; whatever else a table has stays at its scan."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def batch(schema: str, *columns) -> pa.RecordBatch:
    """A record batch with the column names of a DDL string."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's long."""
    return np.ascontiguousarray(values).view(np.int64)


def fold(key: Column, divisor: int) -> Column:
    """CRC-32 of the key as text, modulo the divisor: 0 to divisor - 1."""
    return F.crc32(key.cast("string")) % divisor
