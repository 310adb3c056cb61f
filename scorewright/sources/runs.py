"""Reading the metrics files of many runs."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    LongType,
    NullType,
    StringType,
    StructField,
    StructType,
    VariantType,
)

from scorewright.schemas import METRICS, NAME_MARK, STATES

# Last part before "_metrics.json" is the split, all before it the dataset.
# A folder of that name may hold the file, and folder names may carry their partition column.
_FILE_NAME = r"/(?:model=)?([^/]+)/(?:run=)?(?:([^/]+)_)?([^/_]*)_metrics\.json(?:/[^/]+)?$"


def decoded_path(path: Column) -> Column:
    """A file path as written; Spark's metadata column percent-encodes it."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def run_of_path(path: Column) -> dict[str, Column]:
    """Model, dataset and split that a metrics file's path stands for.

    A name of one part only is dataset and split at once.
    """
    model, dataset, split = (F.regexp_extract(path, _FILE_NAME, group) for group in (1, 2, 3))

    def name(part: Column) -> Column:
        return F.regexp_replace(part, NAME_MARK + "[0-9a-f]{8}$", "")

    return {"model": name(model), "dataset": F.when(dataset == "", split).otherwise(name(dataset)), "split": split}


def _parsed(spark: SparkSession, root: str) -> DataFrame | None:
    """Path, text and parsed content of every metrics file; null content where it is no JSON object. None without any file."""
    files = f"{root.rstrip('/')}/*/*_metrics.json"
    try:
        contents = spark.read.text(files, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = contents.select(decoded_path(F.col("_metadata.file_path")).alias("path"), "value", F.try_parse_json("value").alias("parsed"))
    is_object = F.startswith(F.schema_of_variant("parsed"), F.lit("OBJECT"))
    return rows.withColumn("metrics", F.when(is_object, F.col("parsed"))).drop("parsed")


def _column_type(name: str, found: DataType, known: dict[str, DataType]) -> DataType:
    """The type of a metric whose values over all files have the merged type ``found``.

    Decimal and floating numbers are doubles. Where files disagree, a metric of the known ones has its known type, to
    which a number in quotes converts too; any other is text.
    """
    if isinstance(found, ArrayType):
        return ArrayType(_column_type("", found.elementType, known))
    if isinstance(found, StructType):
        return StructType([StructField(f.name, _column_type("", f.dataType, known)) for f in found.fields])
    if isinstance(found, (DecimalType, FloatType, DoubleType)):
        return DoubleType()
    if isinstance(found, (VariantType, NullType)):
        return known.get(name, StringType())
    # Whole numbers of a metric that is a double elsewhere.
    return known[name] if isinstance(found, LongType) and name in known else found


def metrics_schema(valid: DataFrame) -> StructType:
    """Columns of all metrics files and their types, from one job: every file's own schema, merged by partial aggregation."""
    merged = valid.agg(F.schema_of_variant_agg("metrics")).first()[0]
    if merged is None or merged == "OBJECT<>":
        return StructType([])
    fields = StructType.fromDDL(merged.replace("OBJECT<", "STRUCT<")).fields
    known = {field.name: field.dataType for field in StructType.fromDDL(METRICS).fields}
    return StructType([StructField(f.name, _column_type(f.name, f.dataType, known)) for f in fields])


def _member(name: str, kind: DataType) -> Column:
    quote = '"' if "'" in name else "'"
    return F.try_variant_get("metrics", f"$[{quote}{name}{quote}]", kind.simpleString()).alias(name)


def read_metrics(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    """Metrics of all runs under ``root/{model}/{dataset}_{split}_metrics.json``.

    Files may differ in their keys: the table has them all, null where a file has
    none. They may differ in types too: an accuracy of 0, 0.5 and "0.5" in three files is a double, see
    :func:`metrics_schema`. Files that hold no JSON object, or one key twice, are left out, and named by
    :func:`unreadable_metrics`. Folders below a model's are not read. What
    ``write_metrics`` and so ``evaluate`` write has the same shape and is read alike;
    full names are then in ``model_id`` and ``dataset_id``. Without any file the table
    is empty. A ``schema`` of the metrics saves the pass that infers it.
    """
    rows = _parsed(spark, root)
    if rows is None:
        return spark.createDataFrame([], schema or METRICS)
    valid = rows.where(F.col("metrics").isNotNull())
    run = run_of_path(F.col("path"))
    fields = (schema if schema is not None else metrics_schema(valid)).fields
    return valid.select(
        *[_member(field.name, field.dataType) for field in fields if field.name not in (*run, "run")],
        *[column.alias(name) for name, column in run.items()],
    )


def unreadable_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Path and content of the metrics files that hold no JSON object."""
    rows = _parsed(spark, root)
    if rows is None:
        return spark.createDataFrame([], "path STRING, content STRING")
    return rows.where(F.col("metrics").isNull()).select("path", F.col("value").alias("content"))


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics written by :func:`scorewright.sources.sinks.write_metrics`, all runs of a folder, under full names."""
    ids = StructType.fromDDL("model_id STRING, dataset_id STRING")
    metrics = StructType.fromDDL(METRICS)
    plain = [field for field in metrics.fields if field.name not in ("model", "dataset", "split")]
    found = read_metrics(spark, path, StructType([*ids.fields, *plain]))
    if "model_id" not in found.columns:
        return found
    return found.select(F.col("model_id").alias("model"), F.col("dataset_id").alias("dataset"), "split", *[field.name for field in plain])


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """Counts and times of all parts that ``write_states`` has saved, with their ``part``."""
    return spark.read.schema(f"{STATES}, part STRING").option("basePath", path).parquet(path)
