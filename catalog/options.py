"""Option lists and ground-truth functions."""

from pyspark.sql import functions as F

from catalog.inputs import Query, table
from scorewright.functions import options, truth
from scorewright.functions.text import dataset_label, model_label


def _part(spark, folder):
    return table(spark, folder, "part")


def _option_array():
    return F.array(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit("none"))


def lettered_options(spark, folder):
    return _part(spark, folder).select("p_partkey", options.lettered(_option_array(), "ABCD").alias("lines"))


def zipped_options(spark, folder):
    # One to five labels for four texts.
    labels = F.slice(F.array(*map(F.lit, "ABCDE")), 1, (F.col("p_partkey") % 5 + 1).cast("int"))
    return _part(spark, folder).select("p_partkey", options.labelled_zip(labels, _option_array()).alias("lines"))


def looked_up_options(spark, folder):
    labels = F.slice(F.array(*map(F.lit, "12345")), 1, (F.col("p_partkey") % 5 + 1).cast("int"))
    return _part(spark, folder).select("p_partkey", options.labelled_lookup(labels, _option_array()).alias("lines"))


def numbered_options(spark, folder):
    return _part(spark, folder).select(
        "p_partkey",
        options.numbered(_option_array()).alias("plain"),
        options.numbered(_option_array(), parentheses=True).alias("in_parentheses"),
    )


def parsed_options(spark, folder):
    literal = F.concat(F.lit("['"), F.col("p_name"), F.lit("', \"it's "), F.col("p_brand"), F.lit("\", '"), F.col("p_type"), F.lit("']"))
    return _part(spark, folder).select(
        "p_partkey", options.lettered(options.parse_list(literal), "ABCD").alias("lines")
    )


def relabelled_options(spark, folder):
    packed = F.concat(F.lit("a ) "), F.col("p_name"), F.lit(" , b ) "), F.col("p_brand"), F.lit(" data ) , e ) x"))
    return _part(spark, folder).select("p_partkey", options.relabel_packed(packed).alias("lines"))


def shuffled_options(spark, folder):
    given = [F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_brand")]
    mixed = _part(spark, folder).withColumn("mixed", options.shuffled(given, F.col("p_partkey")))
    return mixed.select(
        "p_partkey",
        F.array_join("mixed", "|").alias("options"),
        options.position_label(F.col("mixed"), F.col("p_brand")).alias("position"),
    )


def truth_letters(spark, folder):
    number = (F.col("p_partkey") % 6).cast("int")
    return _part(spark, folder).select(
        "p_partkey",
        truth.letter_by_list(number - 3, "ABCD").alias("by_list"),
        truth.letter_by_map(number, range(4), "ABCD").alias("by_four"),
        truth.letter_by_map(number, range(2), "AB").alias("by_two"),
        truth.letter_by_map(number.cast("string"), ("1", "2"), "AB").alias("by_text"),
    )


def checked_labels(spark, folder):
    label = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
    label = label.when(F.col("p_partkey") % 5 == 1, F.lit("")).when(F.col("p_partkey") % 5 == 2, F.lit("3.0"))
    label = label.when(F.col("p_partkey") % 5 == 3, (F.col("p_partkey") % 8 - 2).cast("string"))
    return _part(spark, folder).select("p_partkey", truth.checked_letter(label, "ABCD").alias("letter"))


def capitalized_answers(spark, folder):
    return _part(spark, folder).select("p_partkey", truth.capitalized(F.concat("p_name", F.lit(" "), "p_brand")).alias("answer"))


def first_spans(spark, folder):
    spans = F.split("text", "\n")
    return table(spark, folder, "documents").select("doc_id", truth.first_span(spans).alias("answer"))


def output_names(spark, folder):
    # Every URL as a dataset path, every host-like prefix as a model path.
    return table(spark, folder, "pages").select(
        "page_id", dataset_label(F.col("url")).alias("dataset"), model_label(F.col("url")).alias("model")
    )


_LIST = "[p_name, p_brand, p_type, 'none']"
_SHUFFLE = "list_transform(list_sort([" + ", ".join(
    f"{{'o': md5('42|' || p_partkey || '|{i}'), 't': {column}}}"
    for i, column in enumerate(("p_name", "p_brand", "p_type", "p_brand"))
) + "]), lambda s: s.t)"
_LABEL = """case p_partkey % 5 when 0 then ' ' || p_size || ' ' when 1 then '' when 2 then '3.0'
    when 3 then cast(p_partkey % 8 - 2 as varchar) end"""


def _lines(items: str, line: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x, i: {line}), '')"


QUERIES = [
    Query("lettered_options", ("OPT1",), lettered_options,
          f"select p_partkey, {_lines(_LIST, '''substr('ABCD', i, 1) || '. ' || x || chr(10)''')} as lines from part"),
    Query("zipped_options", ("OPT2",), zipped_options,
          f"""select p_partkey, {_lines(_LIST + '[:p_partkey % 5 + 1]', '''substr('ABCDE', i, 1) || '. ' || x || chr(10)''')}
          as lines from part"""),
    Query("looked_up_options", ("OPT3",), looked_up_options,
          f"""select p_partkey, case when p_partkey % 5 < 4 then
            {_lines(_LIST + '[:p_partkey % 5 + 1]', '''i || '. ' || x || chr(10)''')} end as lines from part"""),
    Query("parsed_options", ("OPT4",), parsed_options,
          """select p_partkey, 'A. ' || p_name || chr(10) || 'B. it''s ' || p_brand || chr(10) || 'C. ' || p_type || chr(10)
          as lines from part"""),
    Query("relabelled_options", ("OPT5",), relabelled_options,
          """select p_partkey, 'A.  ' || p_name || ' , B.  ' || p_brand || ' datA.  , E.  x' as lines from part"""),
    Query("numbered_options", ("OPT6",), numbered_options,
          f"""select p_partkey, {_lines(_LIST, '''(i - 1) || '.' || x || chr(10)''')} as plain,
            {_lines(_LIST, '''concat('(', i - 1, ').', x, chr(10))''')} as in_parentheses from part"""),
    Query("shuffled_options", ("OPT7", "OPT8", "OPT9", "GT9"), shuffled_options,
          f"""select p_partkey, array_to_string(mixed, '|') as options,
            '(' || (list_position(mixed, p_brand) - 1) || ')' as position
          from (select p_partkey, p_brand, {_SHUFFLE} as mixed from part)"""),
    Query("truth_letters", ("GT2", "GT3", "GT4", "GT5"), truth_letters,
          """select p_partkey,
            case p_partkey % 6 when 0 then 'B' when 1 then 'C' when 2 then 'D' when 3 then 'A' when 4 then 'B' else 'C' end as by_list,
            case when p_partkey % 6 < 4 then substr('ABCD', p_partkey % 6 + 1, 1) end as by_four,
            case p_partkey % 6 when 0 then 'A' when 1 then 'B' end as by_two,
            case p_partkey % 6 when 1 then 'A' when 2 then 'B' end as by_text
          from part"""),
    Query("checked_labels", ("GT6",), checked_labels,
          f"""select p_partkey, case when not regexp_full_match(coalesce(trim(label), ''), '-?[0-9]+') then 'ERROR_INVALID_LABEL'
              when cast(label as integer) between 0 and 3 then substr('ABCD', cast(label as integer) + 1, 1)
              else 'ERROR_LABEL_OUT_OF_BOUNDS' end as letter
          from (select p_partkey, {_LABEL} as label from part)"""),
    Query("first_spans", ("GT7",), first_spans,
          "select doc_id, string_split(text, chr(10))[1] as answer from documents"),
    Query("capitalized_answers", ("GT8",), capitalized_answers,
          """select p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name || ' ' || p_brand, 2)) as answer from part"""),
    Query("output_names", ("SNK6",), output_names,
          "select page_id, string_split(string_split(url, '/')[-1], '.')[1] as dataset, string_split(url, '/')[-1] as model from pages"),
]
