"""Scoring: join, extraction, correctness and accuracy."""

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs
from catalog.inputs import Query, sql_graded, sql_marker, sql_view, view
from scorewright.operators.benchmarks import BBH
from scorewright.operators.generate import generate
from scorewright.operators.grader import Grader
from scorewright.operators.metrics import run_metrics
from scorewright.operators.score import grade, score


def choice_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, folder, inputs.CHOICE_ITEMS), view(spark, folder, inputs.CHOICE_RESPONSES)


def mixed_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, folder, inputs.MIXED_ITEMS), view(spark, folder, inputs.MIXED_RESPONSES)


def accuracy_by_model(spark, folder):
    metrics = run_metrics(grade(*choice_tables(spark, folder), [BBH]))
    return metrics.select("model", "dataset", "split", "total_samples", "accuracy")


def mixed_accuracy(spark, folder):
    metrics = run_metrics(grade(*mixed_tables(spark, folder)))
    return metrics.select("model", "dataset", "split", "total_samples", "accuracy")


def salted_accuracy(spark, folder):
    metrics = run_metrics(grade(*mixed_tables(spark, folder), salt=8))
    return metrics.select("model", "dataset", "split", "total_samples", "accuracy")


def accuracy_by_subset(spark, folder):
    results = score(*mixed_tables(spark, folder))
    return run_metrics(results, ("dataset", "subset")).select("dataset", "subset", "total_samples", "accuracy")


def result_rows(spark, folder):
    results = score(*mixed_tables(spark, folder))
    return results.select(
        "example_id",
        "prompt",
        "model_response",
        "extracted_answer",
        "ground_truth_answer",
        "ground_truth_reasoning",
        "is_correct",
        "split",
        F.col("metadata.dataset").alias("dataset"),
        F.col("metadata.model").alias("model"),
        F.col("metadata.subset").alias("subset"),
        F.size("logprobs").alias("n_logprobs"),
    )


# Customers are items, orders their responses; a customer without an order stays unanswered.
CUSTOMER_ITEMS = """
select cast(c_custkey as string) as example_id, 'lukaemon/bbh' as dataset, 'test' as split, c_mktsegment as subset,
  c_name as prompt, substr('ABC', cast(1 + c_custkey % 3 as int), 1) as ground_truth
from {customer}"""
ORDER_RESPONSES = """
select cast(o_custkey * 2 as string) as example_id, 'lukaemon/bbh' as dataset, 'test' as split, o_orderpriority as model,
  concat('Answer: ', substr('ABC', cast(1 + o_orderkey % 3 as int), 1)) as response
from {orders}"""


def unanswered_items(spark, folder):
    """Every customer for every priority, and orders of no customer."""
    items, responses = view(spark, folder, CUSTOMER_ITEMS), view(spark, folder, ORDER_RESPONSES)
    graded = grade(items, responses, [BBH], keep_unanswered=True, unmatched="keep")
    return graded.select("example_id", "subset", "model", "extracted_answer", "is_correct")


def missing_pairs_accuracy(spark, folder):
    """Accuracy of every priority over all customers: those without an order of it count as wrong."""
    items, responses = view(spark, folder, CUSTOMER_ITEMS), view(spark, folder, ORDER_RESPONSES)
    metrics = run_metrics(grade(items, responses, [BBH], keep_unanswered=True))
    return metrics.select("model", "dataset", "split", "total_samples", "accuracy")


def generated_accuracy(spark, folder):
    def load_model():
        return lambda prompts: [f"It has {len(prompt)} signs. The answer is: ({'ABCD'[len(prompt) % 4]})." for prompt in prompts]

    items = view(spark, folder, inputs.CHOICE_ITEMS)
    responses = generate(items.select("example_id", "dataset", "split", "prompt"), load_model)
    graded = grade(items, responses.withColumn("model", F.lit("length")), [BBH])
    return graded.select("example_id", "model", "response", "extracted_answer", "is_correct")


# A user's own benchmark: the answer is the last word, and must start with the truth's letter.
LAST_WORD = replace(
    BBH,
    grader=Grader(
        extract=lambda response: F.substring_index(F.btrim(response, F.lit(" .")), " ", -1),
        key=lambda truth: F.substr(truth, F.lit(2), F.lit(1)),
        match=lambda extracted, key: F.startswith(extracted, key),
    ),
)


def user_adapter(spark, folder):
    graded = grade(*choice_tables(spark, folder), [LAST_WORD])
    return graded.groupBy("model", "extracted_answer").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("n_correct")
    )


_CHOICE_ROWS = f"""(select r.*, i.subset, i.prompt, i.ground_truth from {sql_view(inputs.CHOICE_RESPONSES)} r
    join {sql_view(inputs.CHOICE_ITEMS)} i using (dataset, split, example_id))"""
_ASKED = f"""select i.*, m.model from {sql_view(CUSTOMER_ITEMS)} i cross join (select distinct model from {sql_view(ORDER_RESPONSES)}) m"""
_LAST_WORD = "string_split(trim(response, ' .'), ' ')[-1]"
_GENERATED = "'It has ' || length(prompt) || ' signs. The answer is: (' || substr('ABCD', 1 + length(prompt) % 4, 1) || ').'"

QUERIES = [
    Query(
        "accuracy_by_model",
        ("JOIN1", "EXT1", "COR1", "COR2", "AGG1", "AGG2", "FLT4"),
        accuracy_by_model,
        f"""select model, dataset, split, count(*) as total_samples, {inputs.SQL_ACCURACY} as accuracy
        from (select *, {inputs.sql_exact(sql_marker('response'), 'ground_truth')} as is_correct from {_CHOICE_ROWS})
        group by model, dataset, split""",
    ),
    Query("mixed_accuracy", ("UDF3", "JOIN1", "EXT2", "COR3", "COR4", "AGG1", "AGG2"), mixed_accuracy,
          f"select * from {inputs.SQL_RUNS}"),
    Query("salted_accuracy", ("JOIN1", "UDF3"), salted_accuracy, f"select * from {inputs.SQL_RUNS}"),
    Query(
        "accuracy_by_subset",
        ("AGG2", "PRD1"),
        accuracy_by_subset,
        f"""select dataset, subset, count(*) as total_samples, {inputs.SQL_ACCURACY} as accuracy
        from {sql_graded(inputs.SQL_MIXED_ROWS)} group by dataset, subset""",
    ),
    Query(
        "result_rows",
        ("PRJ25", "PRD1", "JOIN1", "COR2"),
        result_rows,
        f"""select example_id, prompt, response as model_response, extracted_answer, ground_truth as ground_truth_answer,
          cast(null as varchar) as ground_truth_reasoning, is_correct, split, dataset, model, subset,
          cast(0 as integer) as n_logprobs
        from {sql_graded(inputs.SQL_MIXED_ROWS)}""",
    ),
    Query(
        "unanswered_items",
        ("JOIN1", "COR2"),
        unanswered_items,
        f"""select example_id, subset, model, {sql_marker('response')} as extracted_answer,
          {inputs.sql_exact(sql_marker('response'), 'ground_truth')} as is_correct
        from ({_ASKED}) full join (select example_id, model, response from {sql_view(ORDER_RESPONSES)}) using (example_id, model)""",
    ),
    Query(
        "missing_pairs_accuracy",
        ("JOIN1", "AGG1", "AGG2"),
        missing_pairs_accuracy,
        f"""select model, 'lukaemon/bbh' as dataset, 'test' as split, count(*) as total_samples,
          cast(count(*) filter (where {inputs.sql_exact(sql_marker('response'), 'ground_truth')}) as double) / count(*) as accuracy
        from ({_ASKED}) left join (select example_id, model, response from {sql_view(ORDER_RESPONSES)}) using (example_id, model)
        group by model""",
    ),
    Query(
        "generated_accuracy",
        ("UDF2", "SRC10"),
        generated_accuracy,
        f"""select example_id, 'length' as model, {_GENERATED} as response,
          '(' || lower(substr('ABCD', 1 + length(prompt) % 4, 1)) || ')' as extracted_answer,
          '(' || substr('ABCD', 1 + length(prompt) % 4, 1) || ')' = ground_truth as is_correct
        from {sql_view(inputs.CHOICE_ITEMS)}""",
    ),
    Query(
        "user_adapter",
        ("UDF1",),
        user_adapter,
        f"""select model, {_LAST_WORD} as extracted_answer, count(*) as n,
          count(*) filter (where ground_truth is not null and starts_with({_LAST_WORD}, substr(ground_truth, 2, 1))) as n_correct
        from {_CHOICE_ROWS} group by 1, 2""",
    ),
]
