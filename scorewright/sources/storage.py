"""Where a job may put tables that all executors must see."""

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str, root: str | None = None) -> str:
    """A fresh folder under ``root``, which is ``spark.checkpoint.dir`` unless given.

    There is no other place that the executors of any cluster share, so one of the two has
    to be named.
    """
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
