"""Incremental scoring with Structured Streaming.

Result rows become durable batch by batch while responses still arrive; the
checkpoint makes a restarted or repeated run add each response once.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scorewright.operators.adapter import Adapter
from scorewright.operators.metrics import run_metrics
from scorewright.operators.score import grade, repeated_items, score
from scorewright.schemas import ITEM_KEYS, RESPONSES, RUN_KEYS

# Responses that a micro-batch has for each item, see :func:`batch_files`.
RESPONSES_PER_ITEM = 4


def stream_responses(
    spark: SparkSession, path: str, format: str = "json", files_per_batch: int | None = None
) -> DataFrame:
    """Responses from the files that land in a folder.

    ``files_per_batch`` bounds a micro-batch, and so how often results are saved; :func:`batch_files` gives a number that
    goes with the items.
    """
    reader = spark.readStream.schema(RESPONSES).format(format)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def batch_files(items: DataFrame, rows_per_file: int, least: int = 1) -> int:
    """How many files of so many responses a micro-batch should take; ``least`` where the items are few.

    A micro-batch reads and joins all items and goes through all keys that are remembered, however few responses it
    has. With ``RESPONSES_PER_ITEM`` of them for each item, all micro-batches together cost what the responses do, and
    not their number times the items.
    """
    return max(least, -(-RESPONSES_PER_ITEM * items.count() // rows_per_file))


def once_each(responses: DataFrame, within: str) -> DataFrame:
    """A stream of responses with one row for each model and item, the first that came.

    Keys are remembered in the stream's state and checkpoint for ``within`` (such as ``7 days``) after their
    response came; what comes again later than that is a new response. Time is that of the micro-batches, so
    that no response is ever too late to be taken.
    """
    timed = responses.withColumn("_came", F.current_timestamp()).withWatermark("_came", within)
    return timed.dropDuplicatesWithinWatermark(["model", *ITEM_KEYS]).drop("_came")


def score_stream(
    items: DataFrame,
    responses: DataFrame,
    path: str,
    checkpoint: str,
    adapters: Sequence[Adapter] | None = None,
    format: str = "json",
    salt: int = 1,
    once_within: str | None = None,
    compression: str | None = None,
) -> StreamingQuery:
    """Append result rows for all responses there are now, then stop.

    The same columns as batch scoring, over a join of the stream with the items
    table; ``salt`` spreads hot items, as there. Rows go to a file sink, one commit
    per micro-batch. Two items of one key end the stream with an error before its
    first row; the items are a table that doesn't change while the stream runs, so
    they are counted once and not in every micro-batch.

    :param once_within: take one response for each model and item, see :func:`once_each`;
        a file that is delivered twice then adds nothing
    :param compression: of the files written, such as ``gzip``, which takes away most of what plain JSON lines repeat;
        the format's own by default
    """
    repeated_items(items)
    if once_within is not None:
        responses = once_each(responses, once_within)
    results = score(items, responses, adapters, salt=salt)
    writer = results.writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint)
    if format == "json":
        writer = writer.option("ignoreNullFields", False)
    if compression is not None:
        writer = writer.option("compression", compression)
    return writer.trigger(availableNow=True).start(path)


def running_accuracy(
    items: DataFrame, responses: DataFrame, adapters: Sequence[Adapter] | None = None, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Streaming sample counts and accuracy by run; the state is one row per run. Two items of one key are an error."""
    repeated_items(items)
    totals = run_metrics(grade(items, responses, adapters), keys)
    return totals.select(*keys, "total_samples", "accuracy")
