"""Evaluation jobs: from items and responses, or a model, to saved results and metrics."""

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions.prompts import chat_messages, is_chat_model
from scorewright.operators.adapter import Adapter
from scorewright.operators.generate import Model, generate
from scorewright.operators.metrics import merged_metrics, metric_states, run_metrics
from scorewright.operators.score import assemble, grade
from scorewright.schemas import RUN_KEYS
from scorewright.session import small_methods
from scorewright.sources.runs import read_states
from scorewright.sources.sinks import write_by_run, write_metrics, write_states


def evaluate(
    items: DataFrame,
    responses: DataFrame,
    output_dir: str,
    adapters: Sequence[Adapter] | None = None,
    format: str = "parquet",
    by_run: bool = False,
    part: str | None = None,
    **options,
) -> DataFrame:
    """Score responses, add their result rows to ``output_dir/rows`` and save the metrics of the runs.

    Metrics go to ``output_dir/model={model}/run={dataset}_{split}_metrics.json``, where
    ``aggregate_runs(spark, output_dir)`` finds them. Without ``part`` they cover the rows of this
    call alone, in the place of what there was for its runs, and each call adds one folder of rows.

    With ``part``, the call is one part of its runs, and their metrics add up over all parts there
    are in ``output_dir``: counts and times of each part are kept in ``output_dir/parts/part={part}``. A
    part that is evaluated again replaces its own rows and counts, and so changes nothing if it is
    the same; its rows are in ``output_dir/rows/evaluation={part}``.

    Responses are read and graded once: the metrics come from
    the saved rows, of which Parquet reads only the few columns they need.

    :param format: file format of the rows, ``parquet`` or ``json``
    :param by_run: lay the rows out in a folder per run, see :func:`write_by_run`
    :param part: name of this part of the runs; letters, digits, ``-``, ``_`` and ``.``
    :param options: of :func:`scorewright.operators.score.grade`
    :return: the metrics, one row per run
    """
    root = output_dir.rstrip("/")
    if part is not None and not re.fullmatch(r"[\w.-]+", part, re.ASCII):
        raise ValueError(f"a part's name has letters, digits, -, _ and . only, not {part}")
    rows = f"{root}/rows/evaluation={uuid.uuid4().hex if part is None else part}"
    graded = grade(items, responses, adapters, **options)
    timing = [name for name in ("started_at", "finished_at") if name in graded.columns]
    results = assemble(graded, adapters, extra=timing)
    mode = "errorifexists" if part is None else "overwrite"
    spark = results.sparkSession
    # Grading makes methods that the JVM would otherwise interpret.
    with small_methods(spark):
        if by_run:
            write_by_run(results, rows, format, mode)
        else:
            results.write.format(format).mode(mode).option("ignoreNullFields", False).save(rows)
    saved = spark.read.schema(results.schema).format(format).load(rows)
    if part is None:
        metrics = run_metrics(saved)
    else:
        write_states(metric_states(saved), f"{root}/parts", part)
        states = read_states(spark, f"{root}/parts")
        # Runs that this part has nothing of stay as they are.
        runs = states.where(F.col("part") == part).select(*RUN_KEYS)
        metrics = merged_metrics(states.join(runs, list(RUN_KEYS), "left_semi"))
    write_metrics(metrics, root)
    return metrics


def respond(items: DataFrame, model: str, load_model: Callable[[], Model], batch_size: int = 8) -> DataFrame:
    """Responses of one model to all items, by the batch inference hook.

    The result should be written before it is scored: models are slow, and need
    not give the same text twice.
    """
    prompts = items.select("example_id", "dataset", "split", "prompt")
    return generate(prompts, load_model, batch_size).drop("prompt").withColumn("model", F.lit(model))


def model_inputs(items: DataFrame, models: DataFrame) -> DataFrame:
    """What each model is to be asked: the prompt, and chat messages for chat models.

    ``models`` holds one row per (``dataset``, ``model``) to run. Models are gathered by
    dataset first, so the join moves one short row for each dataset.
    """
    by_dataset = models.groupBy("dataset").agg(F.collect_list("model").alias("_models"))
    asked = items.join(by_dataset, "dataset").withColumn("model", F.explode("_models")).drop("_models")
    messages = F.when(is_chat_model(F.col("model")), chat_messages(F.col("prompt")))
    return asked.withColumn("messages", messages)
