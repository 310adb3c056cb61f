"""Extraction and correctness rules on their own, over short responses and over whole documents."""

from pyspark.sql import functions as F

from catalog import inputs
from catalog.inputs import Query, sql_view, table, view
from scorewright.functions import extract
from scorewright.operators.grader import EXACT, FINAL_NUMBER, MATH, MATH_BALANCED, NUMBER

DOCUMENTS = inputs.DOCUMENT_RESPONSES


def _over(template, keys, make):
    """A query that puts one extracted column beside the rows' keys."""

    def run(spark, folder):
        return view(spark, folder, template).select(*keys, make(F.col("response")).alias("answer"))

    return run


def _sql_over(template, keys, expression):
    return f"select {', '.join(keys)}, {expression} as answer from {sql_view(template)}"


def _counted(grader):
    """Right, wrong and ungraded rows of a grader by answer."""

    def make(template):
        def run(spark, folder):
            rows = view(spark, folder, template).withColumn("answer", grader.answer(F.col("response")))
            rows = rows.withColumn("is_correct", grader.grade(F.col("answer"), F.col("ground_truth")))
            return rows.groupBy("answer", "is_correct").agg(F.count(F.lit(1)).alias("n"))

        return run

    return make


def _sql_counted(template, answer, match):
    return f"""select answer, {match} as is_correct, count(*) as n
    from (select *, {answer} as answer from {sql_view(template)}) group by 1, 2"""


FINAL = """case when ground_truth is not null and answer is not null then coalesce(abs(try_cast(answer as double)
    - try_cast(replace(regexp_extract(string_split(ground_truth, '####')[-1], '[-+]?[0-9][0-9,]*(?:[.][0-9]+)?'), ',', '')
        as double)) < 1e-6, false) end"""


def labelled_documents(spark, folder):
    """Documents as responses, their quality label as truth: join, long texts, accuracy by language."""
    responses = view(spark, folder, DOCUMENTS).withColumn("answer", extract.after_marker(F.col("response")))
    truths = table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 1, "A").otherwise("B").alias("truth"))
    languages = table(spark, folder, "documents").select("doc_id", "lang")
    graded = responses.select("doc_id", "answer").join(truths, "doc_id", "left").join(languages, "doc_id")
    graded = graded.withColumn("is_correct", EXACT.grade(F.col("answer"), F.col("truth")))
    return graded.groupBy("lang").agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if("is_correct").alias("n_correct"),
        F.sum(F.length("answer")).alias("answer_chars"),
    )


QUERIES = [
    Query("marker_answers", ("EXT1",), _over(inputs.CHOICE_RESPONSES, ["example_id", "model"], extract.after_marker),
          _sql_over(inputs.CHOICE_RESPONSES, ["example_id", "model"], inputs.sql_marker("response"))),
    Query("marker_answers_documents", ("EXT1",), _over(DOCUMENTS, ["doc_id"], extract.after_marker),
          _sql_over(DOCUMENTS, ["doc_id"], inputs.sql_marker("response"))),
    Query("letter_answers", ("EXT2",),
          _over(inputs.CHOICE_RESPONSES, ["example_id", "model"], lambda r: extract.letter_or_marker(r, "ABCD")),
          _sql_over(inputs.CHOICE_RESPONSES, ["example_id", "model"], inputs.sql_letter("response", "ABCD"))),
    Query("letter_answers_documents", ("EXT2",),
          _over(DOCUMENTS, ["doc_id"], lambda r: extract.letter_or_marker(r, "ABCDE")),
          _sql_over(DOCUMENTS, ["doc_id"], inputs.sql_letter("response", "ABCDE"))),
    Query("number_answers", ("EXT3a", "EXT3b", "EXT3c", "EXT3d", "EXT3e"),
          _over(inputs.NUMBER_ROWS, ["l_partkey", "l_orderkey"], extract.number_answer),
          _sql_over(inputs.NUMBER_ROWS, ["l_partkey", "l_orderkey"], inputs.sql_number("response"))),
    Query("number_answers_documents", ("EXT3b", "EXT3c", "EXT3d", "EXT3e"),
          _over(DOCUMENTS, ["doc_id"], extract.number_answer),
          _sql_over(DOCUMENTS, ["doc_id"], inputs.sql_number("response"))),
    Query("math_answers", ("EXT4a", "EXT4b", "EXT4c"),
          _over(inputs.MATH_ROWS, ["l_partkey", "l_orderkey"], extract.math_answer),
          _sql_over(inputs.MATH_ROWS, ["l_partkey", "l_orderkey"], inputs.sql_math("response"))),
    Query("math_answers_documents", ("EXT4a", "EXT4b", "EXT4c"),
          _over(DOCUMENTS, ["doc_id"], extract.math_answer),
          _sql_over(DOCUMENTS, ["doc_id"], inputs.sql_math("response"))),
    Query("number_grades", ("COR3", "COR2"), _counted(NUMBER)(inputs.NUMBER_ROWS),
          _sql_counted(inputs.NUMBER_ROWS, inputs.sql_number("response"), inputs.sql_number_match("answer", "ground_truth"))),
    Query("final_number_grades", ("COR3",), _counted(FINAL_NUMBER)(inputs.NUMBER_ROWS),
          _sql_counted(inputs.NUMBER_ROWS, inputs.sql_number("response"), FINAL)),
    Query("math_grades", ("COR4", "COR2"), _counted(MATH)(inputs.MATH_ROWS),
          _sql_counted(inputs.MATH_ROWS, inputs.sql_math("response"), inputs.sql_math_match("answer", "ground_truth"))),
    Query("balanced_math_answers", ("EXT4a", "EXT4b", "EXT4c"),
          _over(inputs.MATH_ROWS, ["l_partkey", "l_orderkey"], MATH_BALANCED.answer),
          _sql_over(inputs.MATH_ROWS, ["l_partkey", "l_orderkey"], inputs.sql_math("response", inputs.sql_balanced_box))),
    Query("balanced_math_grades", ("COR4",), _counted(MATH_BALANCED)(inputs.MATH_ROWS),
          _sql_counted(inputs.MATH_ROWS, inputs.sql_math("response", inputs.sql_balanced_box),
                       inputs.sql_math_match("answer", "ground_truth", inputs.sql_balanced_box))),
    Query("labelled_documents", ("EXT1", "COR1", "JOIN1"), labelled_documents,
          f"""select lang, count(*) as total_samples, count(*) filter (where {inputs.sql_exact('answer', 'truth')}) as n_correct,
            cast(sum(length(answer)) as bigint) as answer_chars
          from (select doc_id, {inputs.sql_marker('response')} as answer from {sql_view(DOCUMENTS)})
            left join (select doc_id, case when quality = 1 then 'A' else 'B' end as truth from labels) using (doc_id)
            join (select doc_id, lang from documents) using (doc_id)
          group by lang"""),
]
