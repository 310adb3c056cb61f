"""Scoring: items joined to responses, graded row by row."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright import fixed
from scorewright.functions.logprobs import among, as_map, choices_for, fixed_choices, last_of_token, top_candidates
from scorewright.operators.adapter import Adapter, pick_by_dataset
from scorewright.operators.benchmarks import REGISTRY
from scorewright.schemas import ITEM_KEYS, RESPONSE_COLUMNS


def _second_step(
    table: DataFrame,
    adapters: Sequence[Adapter],
    name: str,
    step: Callable[[Adapter], object],
    column: Callable[[object], Column],
) -> DataFrame:
    """The column replaced by its second step, for the datasets that have one."""
    with_step = [adapter for adapter in adapters if step(adapter) is not None]
    if not with_step:
        return table
    return table.withColumn(name, pick_by_dataset(with_step, step, column, otherwise=F.col(name)))


def with_truth_key(items: DataFrame, adapters: Sequence[Adapter]) -> DataFrame:
    """Items with the short form of their truth that grading compares with."""
    found = pick_by_dataset(adapters, lambda a: a.grader.key, lambda key: key(F.col("ground_truth")))
    items = items.withColumns({"truth_key": found, "has_truth": F.col("ground_truth").isNotNull()})
    return _second_step(
        items, adapters, "truth_key", lambda a: a.grader.settle_key, lambda settle: settle(F.col("truth_key"))
    )


def with_extracted_answer(responses: DataFrame, adapters: Sequence[Adapter]) -> DataFrame:
    """Responses with the answer found in their text."""
    found = pick_by_dataset(adapters, lambda a: a.grader.extract, lambda extract: extract(F.col("response")))
    return _second_step(
        responses.withColumn("extracted_answer", found),
        adapters,
        "extracted_answer",
        lambda a: a.grader.settle,
        lambda settle: settle(F.col("response"), F.col("extracted_answer")),
    )


def unique_items(items: DataFrame) -> DataFrame:
    """The items, or an error as soon as they are read if two have one key.

    Keys are counted by partial aggregation in a job of its own that is part of the plan.
    """
    keys = list(ITEM_KEYS)
    most = items.groupBy(*keys).count().agg(F.max("count").alias("most"))
    repeated = F.raise_error(F.lit("several items have the same dataset, split and example_id")).cast("boolean")
    checked = most.select(F.when(F.col("most") > 1, repeated).otherwise(F.lit(True)))
    return items.where(checked.scalar())


def repeated_items(items: DataFrame) -> None:
    """An error that names a key, now, if two items have it; one small job, for joins that go on for longer than a plan."""
    found = items.groupBy(*ITEM_KEYS).count().where("count > 1").head()
    if found is not None:
        raise ValueError(f"{found['count']} items are {'/'.join(str(found[key]) for key in ITEM_KEYS)}")


def unmatched_responses(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses whose item is not there."""
    keys = list(ITEM_KEYS)
    return responses.join(items.select(*keys).distinct(), keys, "left_anti")


def join_responses(
    items: DataFrame,
    responses: DataFrame,
    keep_unanswered: bool = False,
    salt: int = 1,
    unmatched: str = "drop",
    hot_items: DataFrame | None = None,
) -> DataFrame:
    """Match responses with their items by key.

    Items are unique by key; any number of responses may share one. Spark
    broadcasts the items when its own size limit allows, and otherwise its
    adaptive skew join splits a key that holds a large part of the responses.
    ``salt`` spreads every key over that many shuffle partitions without relying
    on adaptive execution, at the price of as many copies of the (narrow) items. These are
    shuffled and never broadcast: Spark's estimate of their size is that of the items alone,
    and the driver would hold all copies.

    With ``keep_unanswered``, every item that a model of its dataset and split did not
    answer is appended as a row of that model with a null response; items that no model
    was asked are appended once, without a model. They come from an anti join on the
    distinct models and keys of the responses, which are reduced before they move, so a
    hot key costs nothing there.

    Responses without an item are left out (``unmatched="drop"``), stay with a null item
    (``"keep"``), or are an error (``"error"``).

    With ``hot_items``, responses come from ``read_bucketed``: they join where they lie, by key and ``item_salt``, and
    the items named there, and no others, have a copy for each of their numbers.
    """
    keys = list(ITEM_KEYS)
    if hot_items is not None and salt > 1:
        raise ValueError("responses in buckets have their salts already")
    if unmatched not in ("drop", "keep", "error"):
        raise ValueError(f"unmatched is drop, keep or error, not {unmatched}")
    how = "inner" if unmatched == "drop" else "left"
    items = items.withColumn("_item", F.lit(True))
    if salt > 1:
        # The input partition's number stays the same when a lost task runs again.
        spread = responses.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salt)))
        copies = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        joined = spread.join(copies.hint("merge"), [*keys, "salt"], how).drop("salt")
    elif hot_items is not None:
        copies = items.join(hot_items, keys, "left").withColumn(
            "item_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
        )
        joined = responses.join(copies.drop("salts"), [*keys, "item_salt"], how).drop("item_salt")
    else:
        joined = responses.join(items, keys, how)
    if unmatched == "error":
        missing = F.raise_error(F.concat(F.lit("no item for response to "), *[F.concat_ws("/", *keys)])).cast("boolean")
        joined = joined.where(F.coalesce("_item", missing))
    if keep_unanswered:
        runs = responses.groupBy("dataset", "split").agg(F.collect_set("model").alias("models"))
        asked = items.join(runs, ["dataset", "split"], "left").withColumn("model", F.explode_outer("models")).drop("models")
        unanswered = asked.join(responses.select("model", *keys).distinct(), ["model", *keys], "left_anti")
        joined = joined.unionByName(unanswered, allowMissingColumns=True)
    return joined.drop("_item")


def grade(
    items: DataFrame,
    responses: DataFrame,
    adapters: Sequence[Adapter] | None = None,
    keep_unanswered: bool = False,
    salt: int = 1,
    unmatched: str = "drop",
    check_items: bool = True,
    top: int | None = fixed.TOP_LOGPROBS,
    hot_items: DataFrame | None = None,
) -> DataFrame:
    """Grade responses of any number of benchmarks and models in one job.

    Answers are extracted, and truths reduced to their keys, before the join. A
    plan that goes on to count therefore drops prompts, truths and response texts
    before anything is shuffled; one that keeps whole results carries them along.

    :param items: ``example_id, dataset, split, subset, prompt, ground_truth``
    :param responses: ``example_id, dataset, split, model, response`` and, if there,
        ``first_token_logprobs``, ``started_at``, ``finished_at``
    :param adapters: adapters of the datasets present; the registered ones by default
    :param keep_unanswered: see :func:`join_responses`, also for ``salt``, ``unmatched`` and ``hot_items``
    :param check_items: fail if two items have one key; not done for streams
    :param top: the likeliest first-token candidates that are looked at; all of them when None
    :return: both tables' columns with ``extracted_answer`` and ``is_correct``
    """
    adapters = list(adapters or REGISTRY.values())
    wanted = RESPONSE_COLUMNS if hot_items is None else (*RESPONSE_COLUMNS, "item_salt")
    responses = responses.select(*[name for name in wanted if name in responses.columns])
    items, responses = (table.withColumn("example_id", F.col("example_id").cast("string")) for table in (items, responses))
    if check_items and not responses.isStreaming:
        items = unique_items(items)
    items = with_truth_key(items, adapters)
    if "first_token_logprobs" in responses.columns:
        # Both are worked out once a row, before the join, and not once a candidate behind it.
        responses = responses.withColumn("candidates", top_candidates(F.col("first_token_logprobs"), top))
        items = items.withColumn("choices", choices_of(adapters))
    answered = with_extracted_answer(responses, adapters)
    joined = join_responses(items, answered, keep_unanswered, salt, unmatched, hot_items)
    match = pick_by_dataset(
        adapters, lambda a: a.grader.match, lambda match: match(F.col("extracted_answer"), F.col("truth_key"))
    )
    # Null, not false, without a truth or a response.
    is_correct = F.when(F.coalesce("has_truth", F.lit(False)) & F.col("extracted_answer").isNotNull(), match)
    return joined.withColumn("is_correct", is_correct).drop("truth_key", "has_truth")


def choices_of(adapters: Sequence[Adapter]) -> Column:
    """Answer choices of each item."""
    return pick_by_dataset(
        adapters,
        lambda a: a.choices,
        lambda given: choices_for(F.col("ground_truth")) if given is None else fixed_choices(given),
    )


def assemble(
    graded: DataFrame, adapters: Sequence[Adapter] | None = None, extra: Sequence[str] = (), prompts: bool = True
) -> DataFrame:
    """Graded rows in the result layout, with any extra columns after it.

    :param prompts: False leaves the prompt null, for results that are read beside the items
    """
    adapters = list(adapters or REGISTRY.values())
    if "first_token_logprobs" in graded.columns:
        if "candidates" not in graded.columns:
            candidates = top_candidates(F.col("first_token_logprobs"))
            graded = graded.withColumns({"candidates": candidates, "choices": choices_of(adapters)})
        # A column for each step, as the next one looks at it several times.
        graded = graded.withColumn("candidates", among(F.col("candidates"), F.col("choices")))
        logprobs = as_map(last_of_token(F.col("candidates")))
    else:
        logprobs = F.create_map().cast("map<string,double>")
    return graded.select(
        "example_id",
        F.col("prompt") if prompts else F.lit(None).cast("string").alias("prompt"),
        F.col("response").alias("model_response"),
        "extracted_answer",
        F.col("ground_truth").alias("ground_truth_answer"),
        F.lit(None).cast("string").alias("ground_truth_reasoning"),
        "is_correct",
        F.struct("dataset", "model", "subset").alias("metadata"),
        logprobs.alias("logprobs"),
        "split",
        *extra,
    )


def score(items: DataFrame, responses: DataFrame, adapters: Sequence[Adapter] | None = None, **options) -> DataFrame:
    """Whole result rows of :func:`grade`, which documents the parameters."""
    return assemble(grade(items, responses, adapters, **options), adapters)
