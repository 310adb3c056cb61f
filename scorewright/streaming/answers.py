"""Responses of a user's model that become durable piece by piece, and go on where a run has stopped.

Items are staged as files of at most so many rows and read as a stream, a few files a micro-batch. Each micro-batch asks
the model only for items that have no saved response of it yet, and appends what it got before the next one starts.
What was saved is known by its keys, not by the stream's checkpoint alone: a run that was killed between saving a piece
and recording it, or that starts over with another checkpoint, finds the responses there and asks nothing again.
Within a piece, each task's responses are saved as it ends, so that what a killed run has to ask again is what its tasks
had in hand; the size of a file bounds that. Each piece looks through the keys of all that is saved, so that a run takes
more files a piece where many are staged, and makes no more than ``MOST_PIECES`` of what it finds at its start.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scorewright.operators.generate import Model
from scorewright.plans.evaluate import respond
from scorewright.schemas import ITEM_KEYS, ITEMS, RESPONSE_COLUMNS, RESPONSES

# Pieces of the files that a run finds staged at its start.
MOST_PIECES = 8


def stage_items(items: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Add items to a folder that answers are made from, in files of at most so many rows."""
    items.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def saved_keys(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    """Keys of the items that have a saved response of the model; None where nothing is saved."""
    try:
        saved = spark.read.schema(RESPONSES).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # Parquet reads no texts for this.
    return saved.where(saved["model"] == model).select(*ITEM_KEYS).distinct()


def unasked(items: DataFrame, path: str, model: str) -> DataFrame:
    """Items without a saved response of the model; equal keys are one item."""
    items = items.dropDuplicates(list(ITEM_KEYS))
    keys = saved_keys(items.sparkSession, path, model)
    return items if keys is None else items.join(keys, list(ITEM_KEYS), "left_anti")


def answer_stream(
    spark: SparkSession,
    staged: str,
    model: str,
    load_model: Callable[[], Model],
    path: str,
    checkpoint: str,
    batch_size: int = 8,
    files_per_piece: int = 1,
) -> StreamingQuery:
    """Ask a model for all staged items that it hasn't answered, then stop; responses are added to ``path``.

    :param staged: folder of ``stage_items``; files may be added while it runs or between runs
    :param files_per_piece: files of items that make a piece, as long as these make ``MOST_PIECES`` at most; more files
        are answered in tasks that have about one file's items each
    """
    files = max(files_per_piece, -(-len(spark.read.schema(ITEMS).parquet(staged).inputFiles()) // MOST_PIECES))
    items = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", files).parquet(staged)

    def answer(piece: DataFrame, number: int) -> None:
        todo = unasked(piece, path, model)
        if files > files_per_piece:
            todo = todo.repartition(files, *ITEM_KEYS)
        responses = respond(todo, model, load_model, batch_size).select(*RESPONSE_COLUMNS)
        # By this rule of the committer, a finished task's file is there even if the piece never ends. Files
        # are named by task, so that a repeated task replaces its own.
        writer = responses.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.parquet(path)

    writer = items.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()

