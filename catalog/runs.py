"""Metrics of runs and reports over many runs, all from scored line items."""

from pyspark.sql import functions as F

from catalog import inputs
from catalog.inputs import Query, shared_folder, table
from catalog.scoring import mixed_tables
from scorewright.functions.text import dataset_label
from scorewright.operators import metrics
from scorewright.operators.score import grade
from scorewright.sources.blocks import read_accuracy_cells, write_accuracy_blocks

# Two splits by the part's type, so that a model has several runs of one dataset.
SPLIT = "case when subset < 'M' then 'test' else 'validation' end"


def scored_runs(spark, folder):
    """Runs of every model and benchmark on two splits; tiny models lack an accuracy."""
    graded = grade(*mixed_tables(spark, folder)).withColumn("split", F.expr(SPLIT))
    runs = metrics.run_metrics(graded).select("model", "dataset", "split", "total_samples", "accuracy")
    runs = runs.withColumn("dataset", dataset_label(F.col("dataset")))
    return runs.withColumn("accuracy", F.when(F.col("model") != "org/Model-5", F.col("accuracy")))


SQL_SCORED_RUNS = f"""(select model, string_split(dataset, '/')[-1] as dataset, split, count(*) as total_samples,
    case when model <> 'org/Model-5' then {inputs.SQL_ACCURACY} end as accuracy
  from (select * replace ({SPLIT} as split) from {inputs.sql_graded(inputs.SQL_MIXED_ROWS)}) group by 1, 2, 3)"""

DATASETS = ("MATH-lighteval", "MuSR", "ai2_arc", "bbh", "gsm8k", "mmlu")


def _timed_events(spark, folder):
    """Events as timed responses: one run for each event type."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("model"),
        F.lit("events").alias("dataset"),
        F.lit("test").alias("split"),
        (F.col("value") > 10).alias("is_correct"),
        F.col("ts").alias("started_at"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("user_id") * 1000).alias("finished_at"),
    )


def run_throughput(spark, folder):
    return metrics.run_metrics(_timed_events(spark, folder))


def busy_throughput(spark, folder):
    """The same runs, timed without the gaps in which nothing was asked."""
    found = metrics.busy_metrics(_timed_events(spark, folder))
    return found.select("model", "total_samples", "total_time", "busy_time", "samples_per_busy_second")


def wide_metrics(spark, folder):
    """Runs that report different metrics, as one table."""
    path = shared_folder(spark, "runs")
    scored_runs(spark, folder).write.parquet(path)
    runs = spark.read.parquet(path)
    timed = runs.where("split = 'test'").withColumn("total_time", F.col("total_samples") / 4)
    untimed = runs.where("split <> 'test'").drop("accuracy").withColumn("checked", F.col("total_samples") > 100)
    return metrics.wide_metrics(metrics.merge_metrics([timed, untimed]))


def accuracy_matrix(spark, folder):
    # Finding the columns reads the runs once more, so they are saved first.
    path = shared_folder(spark, "runs")
    scored_runs(spark, folder).write.parquet(path)
    return metrics.accuracy_matrix(spark.read.parquet(path))


def accuracy_blocks(spark, folder):
    """The matrix by split in blocks of five columns, read back for the columns of two datasets."""
    path = shared_folder(spark, "blocks")
    write_accuracy_blocks(scored_runs(spark, folder), path, width=5, by_split=True)
    return read_accuracy_cells(spark, path, [f"{name}_{split}" for name in ("bbh", "mmlu") for split in ("test", "validation")])


def accuracy_matrix_by_split(spark, folder):
    columns = [f"{name}_{split}" for name in DATASETS for split in ("test", "validation")]
    return metrics.accuracy_matrix(scored_runs(spark, folder), columns, by_split=True)


def models_and_datasets(spark, folder):
    """Sorted names with their positions; scoring runs once, both lists come from its saved runs."""
    path = shared_folder(spark, "runs")
    scored_runs(spark, folder).write.parquet(path)
    runs = spark.read.parquet(path)

    def numbered(kind):
        # One part keeps the order of the sorted frame, so the ids count its rows.
        names = metrics.distinct_sorted(runs, kind).coalesce(1)
        return names.select(F.lit(kind).alias("kind"), F.col(kind).alias("name"), F.monotonically_increasing_id().alias("position"))

    return numbered("model").unionByName(numbered("dataset"))


def _cell(condition: str) -> str:
    return f"max_by(coalesce(accuracy, 0.0), split) filter (where {condition})"


QUERIES = [
    Query("run_throughput", ("AGG3", "AGG1", "AGG2"), run_throughput,
          """select *, total_samples / total_time as samples_per_second
          from (select event_type as model, 'events' as dataset, 'test' as split, count(*) as total_samples,
              cast(count(*) filter (where value > 10) as double) / count(*) as accuracy,
              (max(epoch_us(ts) + user_id * 1000) - min(epoch_us(ts))) / 1e6 as total_time
            from events group by event_type)"""),
    Query("busy_throughput", ("AGG3",), busy_throughput,
          """with times as (select event_type as model, epoch_us(ts) as a, epoch_us(ts) + user_id * 1000 as b from events),
          ordered as (select *, max(b) over (partition by model order by a, b rows between unbounded preceding and 1 preceding) as latest from times),
          busy as (select model, count(*) as total_samples, (max(b) - min(a)) / 1e6 as total_time,
              sum(greatest(0, b - greatest(a, coalesce(latest, a)))) / 1e6 as busy_time from ordered group by model)
          select *, total_samples / busy_time as samples_per_busy_second from busy"""),
    Query("scored_runs", ("AGG1", "AGG2", "SNK6"), scored_runs, f"select * from {SQL_SCORED_RUNS}"),
    Query("wide_metrics", ("AGG4", "SRC9", "PRJ26", "AGG5"), wide_metrics,
          f"""select model, case when split = 'test' then accuracy end as accuracy,
            case when split <> 'test' then total_samples > 100 end as checked, total_samples,
            case when split = 'test' then total_samples / 4 end as total_time, dataset, split from {SQL_SCORED_RUNS}"""),
    Query("accuracy_matrix", ("AGG5", "AGG6", "AGG7", "SRT1"), accuracy_matrix,
          "select model, " + ", ".join(f"""{_cell(f"dataset = '{name}'")} as "{name}" """ for name in DATASETS)
          + f" from {SQL_SCORED_RUNS} group by model"),
    Query("accuracy_matrix_by_split", ("AGG6", "AGG7"), accuracy_matrix_by_split,
          "select model, " + ", ".join(
              f"""{_cell(f"dataset = '{name}' and split = '{split}'")} as "{name}_{split}" """
              for name in DATASETS for split in ("test", "validation"))
          + f" from {SQL_SCORED_RUNS} group by model"),
    Query("accuracy_blocks", ("AGG7", "SNK5", "SRT1"), accuracy_blocks,
          f"""select model, dataset || '_' || split as column, coalesce(accuracy, 0.0) as accuracy from {SQL_SCORED_RUNS}
          where dataset in ('bbh', 'mmlu')"""),
    Query("models_and_datasets", ("SET1", "SRT1"), models_and_datasets,
          f"""select 'model' as kind, name, row_number() over (order by name) - 1 as position
            from (select distinct model as name from {SQL_SCORED_RUNS})
          union all select 'dataset', name, row_number() over (order by name) - 1
            from (select distinct dataset as name from {SQL_SCORED_RUNS})"""),
]
