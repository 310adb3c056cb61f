"""Sources, sinks and streams: each query writes a table derived from the test tables and reads it back.

What is written goes to a fresh folder under the session's ``spark.checkpoint.dir``, or one of the catalog's own.
"""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog import inputs
from catalog.inputs import Query, shared_folder, table, view
from catalog.runs import DATASETS, SQL_SCORED_RUNS, scored_runs
from catalog.scoring import choice_tables, mixed_tables
from scorewright.operators.benchmarks import BBH
from scorewright.operators.items import build_items, with_content_id
from scorewright.operators.score import score
from scorewright.plans.aggregate import aggregate_runs
from scorewright.plans.evaluate import evaluate
from scorewright.schemas import RESPONSES, RESULTS
from scorewright.sources import benchmark, sinks
from scorewright.sources.bucketed import read_bucketed, write_bucketed
from scorewright.sources.runs import read_metrics, read_run_metrics
from scorewright.streaming.answers import answer_stream, stage_items
from scorewright.streaming.incremental import batch_files, running_accuracy, score_stream, stream_responses


# So many responses arrive in a file at most.
ROWS_PER_FILE = 50_000


def _benchmark_folder(spark, folder):
    """Parts as a benchmark table of two splits, one folder per split and subset."""
    path = shared_folder(spark, "benchmark")
    parts = table(spark, folder, "part").selectExpr(
        "p_partkey as example_id",
        "p_name as input",
        "p_brand as target",
        "if(p_size > 20, 'test', 'train') as split",
        "p_type as subset",
    )
    parts.write.partitionBy("split", "subset").parquet(path)
    return path


def benchmark_items(spark, folder):
    path = _benchmark_folder(spark, folder)
    everything = build_items(benchmark.read_benchmark(spark, path, BBH), BBH)
    one_subset = build_items(benchmark.read_benchmark(spark, path, BBH, split="train", subset="ECONOMY"), BBH)
    return everything.unionByName(one_subset).select("example_id", "split", "subset", "ground_truth")


def benchmark_subsets(spark, folder):
    rows = spark.read.parquet(_benchmark_folder(spark, folder))
    return benchmark.list_subsets(rows).unionByName(benchmark.list_subsets(rows, "ECONOMY"))


def subset_folders(spark, folder):
    path = _benchmark_folder(spark, folder)
    found = benchmark.list_subset_folders(spark, path, split="test")
    return found.unionByName(benchmark.list_subset_folders(spark, path, subset="ECONOMY"))


def content_keys(spark, folder):
    """Responses as a table without a key, two thirds of them told apart by model and text alone."""
    rows = view(spark, folder, inputs.CHOICE_RESPONSES).selectExpr("model", "response as input", "if(cast(example_id as long) % 3 = 0, example_id, null) as target")
    keyed = with_content_id(rows)
    return keyed.groupBy("model", "input", "target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("example_id").alias("n_keys"))


def repeated_deliveries(spark, folder):
    """Every file of responses delivered twice, the second time while the stream is stopped."""
    items, responses = choice_tables(spark, folder)
    first = responses.dropDuplicates(["model", "example_id"])
    path, scored, checkpoint = (shared_folder(spark, name) for name in ("arriving", "scored", "checkpoint"))
    first.write.option("maxRecordsPerFile", ROWS_PER_FILE).json(path)
    files = batch_files(items, ROWS_PER_FILE, least=4)
    for _ in range(2):
        arriving = stream_responses(spark, path, files_per_batch=files)
        score_stream(items, arriving, scored, checkpoint, [BBH], once_within="1 day").awaitTermination()
        spark.read.schema(RESPONSES).json(path).write.mode("append").json(path)
    return _result_columns(spark.read.schema(RESULTS).json(scored)).select("example_id", "model", F.col("is_correct").isNull().alias("no_truth"))


def concatenated_subsets(spark, folder):
    tables = {
        "docs": table(spark, folder, "documents").selectExpr("doc_id as example_id", "text as input", "lang as target"),
        "chats": table(spark, folder, "conversations").selectExpr("conv_id as example_id", "text as input"),
    }
    return benchmark.concat_subsets(tables)


def synthetic_items(spark, folder):
    path = shared_folder(spark, "synthetic") + "/made_bbh_syn_all.json"
    table(spark, folder, "documents").selectExpr(
        "doc_id as example_id", "text as problem", "lang as answer", "named_struct('subset', source) as metadata"
    ).write.json(path)
    schema = StructType.fromDDL("example_id BIGINT, problem STRING, answer STRING, metadata STRUCT<subset: STRING>")
    items = build_items(benchmark.read_synthetic(spark, path, schema), path)
    return items.select("example_id", F.regexp_extract("dataset", "[^/]+$", 0).alias("dataset"), "subset", "prompt", "ground_truth")


def response_lists(spark, folder):
    path = shared_folder(spark, "responses")
    rows = view(spark, folder, inputs.CHOICE_RESPONSES)
    rows.withColumn("outputs", F.array("response", F.lit("second"))).drop("response").write.parquet(path)
    return benchmark.read_responses(spark, path).select("example_id", "model", "response")


def _result_columns(results):
    return results.select(
        "example_id",
        F.col("metadata.model").alias("model"),
        "model_response",
        "extracted_answer",
        "ground_truth_answer",
        "is_correct",
    )


def appended_rows(spark, folder):
    path = shared_folder(spark, "rows")
    results = score(*choice_tables(spark, folder), [BBH])
    sinks.append_rows(results.where("is_correct"), path, "gzip")
    sinks.append_rows(results.where("is_correct is distinct from true"), path, "gzip")
    return _result_columns(spark.read.schema(RESULTS).json(path))


def result_arrays(spark, folder):
    path = shared_folder(spark, "arrays")
    results = score(*choice_tables(spark, folder), [BBH])
    sinks.write_arrays(results, path, "gzip")
    return _result_columns(spark.read.schema(RESULTS).option("multiLine", True).json(path))


def saved_metrics(spark, folder):
    path = shared_folder(spark, "evaluation")
    evaluate(*mixed_tables(spark, folder), path)
    saved = read_run_metrics(spark, path)
    return saved.select("model", "dataset", "split", "total_samples", "accuracy")


def evaluated_reports(spark, folder):
    """From items and responses to the two reports: evaluated twice, read back, as rows of (report, model, dataset, value)."""
    path = shared_folder(spark, "evaluation")
    items, responses = mixed_tables(spark, folder)
    evaluate(items, responses, path)
    # The models once more under another organisation, to meet the first ones' short names.
    evaluate(items, responses.withColumn("model", F.replace("model", F.lit("org/"), F.lit("other/"))), path)
    wide, matrix = aggregate_runs(spark, path, f"{path}-reports")
    long = matrix.unpivot("model", [c for c in matrix.columns if c != "model"], "dataset", "value")
    total = F.col("total_samples").cast("double").alias("value")
    rows = wide.select(F.lit("wide").alias("report"), "model", "dataset", total)
    return rows.unionByName(long.select(F.lit("matrix").alias("report"), "model", "dataset", "value"))


def metrics_of_parts(spark, folder):
    """Runs evaluated in two parts, the second of them twice."""
    path = shared_folder(spark, "evaluation")
    items, responses = mixed_tables(spark, folder)
    late = F.length("response") % 2 == 0
    evaluate(items, responses.where(~late), path, part="early")
    for _ in range(2):
        evaluate(items, responses.where(late), path, part="late")
    return read_run_metrics(spark, path).select("model", "dataset", "split", "total_samples", "accuracy")


def bucketed_rows(spark, folder):
    """Whole result rows of responses that are saved in buckets first, with the items of many responses spread."""
    path = shared_folder(spark, "bucketed")
    items, responses = mixed_tables(spark, folder)
    write_bucketed(responses, path, 8, hot_rows=40)
    bucketed, hot = read_bucketed(spark, path)
    return _result_columns(score(items, bucketed, hot_items=hot))


def resumed_answers(spark, folder):
    """A model asked for the items that are there, and once more for all when others have come; it says in which run."""
    items = view(spark, folder, inputs.CHOICE_ITEMS)
    staged, path = shared_folder(spark, "staged"), shared_folder(spark, "answers")

    def model_of(run):
        return lambda: lambda prompts: [f"Run {run}, {len(prompt)} signs." for prompt in prompts]

    for run, part in ((1, "example_id % 2 = 0"), (2, "example_id % 2 = 1")):
        stage_items(items.where(part), staged)
        # The second run has no memory of the first but what is saved.
        answer_stream(spark, staged, "length", model_of(run), path, shared_folder(spark, "checkpoint")).awaitTermination()
    return benchmark.read_responses(spark, path).select("example_id", "dataset", "split", "model", "response")


def metrics_files(spark, folder):
    """One metrics file per run, some broken, some without a sample count, and files of other names beside them."""
    path = shared_folder(spark, "runs")
    record = F.to_json(
        F.struct("accuracy", F.when(F.col("split") == "test", F.col("total_samples")).alias("total_samples"))
    )
    scored_runs(spark, folder).select(
        F.substring_index("model", "/", -1).alias("model"),
        F.explode(F.array(F.lit("metrics.json"), F.lit("all.json"))).alias("kind"),
        "dataset",
        "split",
        F.when(F.col("dataset") == "mmlu", F.lit("{broken")).otherwise(record).alias("value"),
    ).select("model", F.concat_ws("_", "dataset", "split", "kind").alias("run"), "value").write.partitionBy("model", "run").text(path)
    return read_metrics(spark, path).select("model", "dataset", "split", "total_samples", "accuracy")


def conflicting_metrics(spark, folder):
    """One metrics file per run whose accuracy is a number, a number in quotes or a whole number, by split and dataset."""
    path = shared_folder(spark, "runs")
    runs = scored_runs(spark, folder).where("accuracy is not null")
    shown = (
        F.when(F.col("dataset") == "mmlu", F.to_json(F.struct(F.col("accuracy").cast("string").alias("accuracy"), F.lit(1).alias("note"))))
        .when(F.col("dataset") == "bbh", F.to_json(F.struct(F.lit(0).alias("accuracy"), F.lit("one").alias("note"))))
        .otherwise(F.to_json(F.struct("accuracy", "total_samples")))
    )
    named = runs.select(F.substring_index("model", "/", -1).alias("model"), F.concat_ws("_", "dataset", "split", F.lit("metrics.json")).alias("run"), shown.alias("value"))
    named.write.partitionBy("model", "run").text(path)
    return read_metrics(spark, path).select("model", "dataset", "split", "total_samples", "accuracy", "note")


def wide_metrics_csv(spark, folder):
    path = shared_folder(spark, "wide")
    sinks.write_wide_metrics(scored_runs(spark, folder), path)
    return spark.read.option("header", True).schema("model STRING, accuracy DOUBLE, total_samples LONG, dataset STRING, split STRING").csv(path)


def accuracy_matrix_csv(spark, folder):
    path = shared_folder(spark, "matrix")
    sinks.write_accuracy_matrix(scored_runs(spark, folder), path, list(DATASETS))
    columns = ", ".join(f"`{name}` DOUBLE" for name in sorted(DATASETS))
    return spark.read.option("header", True).schema(f"model STRING, {columns}").csv(path)


def _arriving(spark, folder):
    """Items, and a folder of response files."""
    items, responses = choice_tables(spark, folder)
    path = shared_folder(spark, "arriving")
    responses.write.option("maxRecordsPerFile", ROWS_PER_FILE).json(path, compression="gzip")
    return items, stream_responses(spark, path, files_per_batch=batch_files(items, ROWS_PER_FILE, least=4))


def incremental_rows(spark, folder):
    items, arriving = _arriving(spark, folder)
    path, checkpoint = shared_folder(spark, "scored"), shared_folder(spark, "checkpoint")
    for _ in range(2):  # The second run finds nothing new and must add nothing.
        score_stream(items, arriving, path, checkpoint, [BBH], compression="gzip").awaitTermination()
    return _result_columns(spark.read.schema(RESULTS).json(path))


def incremental_accuracy(spark, folder):
    """Running totals; every micro-batch puts its own in the place of the last ones."""
    items, arriving = _arriving(spark, folder)
    path, checkpoint = shared_folder(spark, "totals"), shared_folder(spark, "checkpoint")
    totals = running_accuracy(items, arriving, [BBH])

    def save(batch, number):
        batch.write.mode("overwrite").parquet(path)

    stream = totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    stream.foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


_CHOICE_ROWS = f"""(select r.*, i.ground_truth from {inputs.sql_view(inputs.CHOICE_RESPONSES)} r
    join {inputs.sql_view(inputs.CHOICE_ITEMS)} i using (dataset, split, example_id))"""
_SQL_RESULTS = f"""select example_id, model, response as model_response, {inputs.sql_marker('response')} as extracted_answer,
    ground_truth as ground_truth_answer, {inputs.sql_exact(inputs.sql_marker('response'), 'ground_truth')} as is_correct
  from {_CHOICE_ROWS}"""
_SQL_INSTRUCTED = inputs.text(BBH.instruction + "\n ")
_SQL_SPLIT = "case when p_size > 20 then 'test' else 'train' end"

QUERIES = [
    Query("benchmark_items", ("SRC1", "SRC3"), benchmark_items,
          f"""select cast(p_partkey as varchar) as example_id, {_SQL_SPLIT} as split, p_type as subset, p_brand as ground_truth
          from part where p_size > 20 or p_type = 'ECONOMY'"""),
    Query("benchmark_subsets", ("SRC2",), benchmark_subsets,
          """select distinct p_type as subset from part
          union all select distinct p_type from part where p_type = 'ECONOMY'"""),
    Query("subset_folders", ("SRC2",), subset_folders,
          """select distinct p_type as subset from part where p_size > 20
          union all select distinct p_type from part where p_type = 'ECONOMY'"""),
    Query("content_keys", ("JOIN1",), content_keys,
          f"""select model, response as input, case when cast(example_id as bigint) % 3 = 0 then example_id end as target, count(*) as n, count(*) as n_keys
          from {inputs.sql_view(inputs.CHOICE_RESPONSES)} group by all"""),
    Query("repeated_deliveries", ("STR1", "JOIN1"), repeated_deliveries,
          f"""select example_id, model, i.ground_truth is null as no_truth
          from (select distinct dataset, split, example_id, model from {inputs.sql_view(inputs.CHOICE_RESPONSES)}) r
          join {inputs.sql_view(inputs.CHOICE_ITEMS)} i using (dataset, split, example_id)"""),
    Query("concatenated_subsets", ("SRC3", "SRC4"), concatenated_subsets,
          """select doc_id as example_id, text as input, lang as target, 'docs' as subset from documents
          union all select conv_id, text, null, 'chats' from conversations"""),
    Query("synthetic_items", ("SRC5", "PRD1", "UDF3"), synthetic_items,
          f"""select cast(doc_id as varchar) as example_id, 'made_bbh_syn_all.json' as dataset, source as subset,
            {_SQL_INSTRUCTED} || text as prompt, lang as ground_truth from documents"""),
    Query("response_lists", ("SRC10",), response_lists,
          f"select example_id, model, response from {inputs.sql_view(inputs.CHOICE_RESPONSES)}"),
    Query("appended_rows", ("SNK1",), appended_rows, _SQL_RESULTS),
    Query("result_arrays", ("SNK2",), result_arrays, _SQL_RESULTS),
    Query("saved_metrics", ("SNK3", "SNK6"), saved_metrics,
          f"select model, dataset, split, total_samples, accuracy from {inputs.SQL_RUNS}"),
    Query("evaluated_reports", ("SRC6", "SRC7", "SNK3", "SNK6", "AGG4", "AGG7"), evaluated_reports,
          f"""with runs as (select o.org || string_split(model, '/')[-1] as model, string_split(dataset, '/')[-1] as dataset,
              total_samples, accuracy from {inputs.SQL_RUNS}, (select unnest(['org/', 'other/']) as org) o)
          select 'wide' as report, model, dataset, cast(total_samples as double) as value from runs
          union all select 'matrix', m.model, d.dataset, r.accuracy
            from (select distinct model from runs) m cross join (select distinct dataset from runs) d
            left join runs r on r.model = m.model and r.dataset = d.dataset"""),
    Query("metrics_of_parts", ("SNK3", "AGG1", "AGG2", "AGG3"), metrics_of_parts,
          f"select model, dataset, split, total_samples, accuracy from {inputs.SQL_RUNS}"),
    Query("bucketed_rows", ("JOIN1", "PRJ25"), bucketed_rows,
          f"""select example_id, model, response as model_response, extracted_answer, ground_truth as ground_truth_answer, is_correct
          from {inputs.sql_graded(inputs.SQL_MIXED_ROWS)}"""),
    Query("resumed_answers", ("SNK7", "UDF2"), resumed_answers,
          f"""select example_id, dataset, split, 'length' as model,
            'Run ' || (1 + cast(example_id as bigint) % 2) || ', ' || length(prompt) || ' signs.' as response
          from {inputs.sql_view(inputs.CHOICE_ITEMS)}"""),
    Query("metrics_files", ("SRC6", "SRC7", "SRC8", "SRC9", "FLT3"), metrics_files,
          f"""select string_split(model, '/')[-1] as model, dataset, split,
            case when split = 'test' then total_samples end as total_samples, accuracy
          from {SQL_SCORED_RUNS} where dataset <> 'mmlu'"""),
    Query("conflicting_metrics", ("SRC8", "SRC9"), conflicting_metrics,
          f"""select string_split(model, '/')[-1] as model, dataset, split, case when dataset not in ('mmlu', 'bbh') then total_samples end as total_samples,
            case when dataset = 'bbh' then 0.0 else accuracy end as accuracy, case dataset when 'mmlu' then '1' when 'bbh' then 'one' end as note
          from {SQL_SCORED_RUNS} where accuracy is not null"""),
    Query("wide_metrics_csv", ("SNK4", "AGG4", "PRJ26"), wide_metrics_csv,
          f"select model, accuracy, total_samples, dataset, split from {SQL_SCORED_RUNS}"),
    Query("accuracy_matrix_csv", ("SNK5", "AGG7"), accuracy_matrix_csv,
          "select model, " + ", ".join(
              f"max_by(coalesce(accuracy, 0.0), split) filter (where dataset = '{name}') as \"{name}\"" for name in DATASETS)
          + f" from {SQL_SCORED_RUNS} group by model"),
    Query("incremental_rows", ("STR1", "SNK7"), incremental_rows, _SQL_RESULTS),
    Query("incremental_accuracy", ("STR1", "AGG2"), incremental_accuracy,
          f"""select model, dataset, split, count(*) as total_samples, {inputs.SQL_ACCURACY} as accuracy
          from (select *, {inputs.sql_exact(inputs.sql_marker('response'), 'ground_truth')} as is_correct from {_CHOICE_ROWS})
          group by model, dataset, split"""),
]
