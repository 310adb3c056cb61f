"""A corpus from raw documents to a training mixture, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return rows with the columns of documents.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.decontaminate import uncontaminated
from scorewright.llm.jaccard_join import jaccard_join
from scorewright.llm.mixing import label_domains, mix
from scorewright.llm.quality_crf import fit, good_documents
from scorewright.llm.session import remove_folder, shared_folder
from scorewright.llm.suffix_dedup import without_repeats

# Column that rows are told apart by in a stage; documents have none of that name.
ROW = "_row_of_the_pipeline"
TARGETS = {"clean": 0.9, "junk": 0.08, "toxic": 0.02}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest key stays.

    Rows are told apart by a hash of key and text, so that of several texts of one key each has groups of its own, and
    rows without a key have them too; they come after all keys, in the order of the hash. Of rows equal in key and text,
    one stays. The text's length is compared beside the hash wherever a row goes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.xxhash64("doc_id", text)
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row.alias("_row"), F.octet_length(text).alias("_n"))
    groups = jaccard_join(docs.withColumn(ROW, row), n=5, share=80, of=100, key=ROW)
    groups = groups.where("n_links > 0").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).distinct()
    rows = docs.select(row.alias("_row"), "doc_id", F.octet_length(text).alias("_n")).join(groups, "_row").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("no_key"), "doc_id", "_row", "_n")
    first = rows.groupBy("_group").agg(F.min(order).alias("first"))
    gone = rows.join(first, "_group").where(order != F.col("first")).select("_row", "_n", F.lit(True).alias("_gone"))
    left = named.join(gone.distinct(), ["_row", "_n"], "left_anti")
    # Dropping repeated rows by what was joined on neither moves nor sorts rows again.
    return left.dropDuplicates(["_row", "_n"]).select("row.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand in more than one place are cut out; all documents stay."""
    cut = without_repeats(docs, length=200)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's memberships and rate."""
    return mix(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_target_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; what lies between them goes to the shared folder.

    A stage's table is removed when the next one's is written; the last table has to stay, as the result is read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove_folder(spark, f"{folder}/{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


# A classifier fitted by gradient steps can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
