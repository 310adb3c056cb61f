"""What the queries share: the test tables, views on them, and SQL text for the oracles.

The test tables hold no model responses, so views make them from their rows: an
item for every part, a response for every line item.
"""

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from scorewright import fixed
from scorewright.sources import storage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels",
          "conversations", "benchmark", "pages", "embeddings")


# Parts that tables which become responses are dealt out to, for test tables in one file that cannot be split. The
# bench sets it to its number of cores; nothing else does.
DEALT: int | None = None


@dataclass(frozen=True)
class Query:
    """A registered query.

    :param ids: operators it shows
    :param run: the query in Spark, over the tables of a folder
    :param sql: the same result in SQL; None where SQL cannot say it
    """

    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_OWN_FOLDER: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; under one folder of this process, which goes with it, where a local
    session has no such setting."""
    master = spark.conf.get("spark.master", "")
    if spark.conf.get("spark.checkpoint.dir", None) or not master.startswith("local") or master.startswith("local-cluster"):
        return storage.shared_folder(spark, purpose)
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.TemporaryDirectory(prefix="catalog-"))
    return storage.shared_folder(spark, purpose, _OWN_FOLDER[0].name)


def view(spark: SparkSession, folder: str, template: str) -> DataFrame:
    """A view in Spark, over the folder's tables that it names."""
    tables = {name: table(spark, folder, name) for name in TABLES if f"{{{name}}}" in template}
    if DEALT is not None:
        tables = {name: rows.repartition(DEALT) if name in ("lineitem", "documents") else rows for name, rows in tables.items()}
    return spark.sql(template, **tables)


def sql_view(template: str) -> str:
    """The same view as a subquery for the oracle."""
    return "(" + template.format(**{name: name for name in TABLES}) + ")"


def text(value: str) -> str:
    """An SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def joined(*parts: str) -> str:
    """SQL concatenation that is null when a part is, as ``||`` is."""
    return " || ".join(f"({part})" for part in parts)


# --- the rules in SQL -------------------------------------------------------------------


def sql_marker(response: str) -> str:
    after = f"string_split(string_split(lower({response}), 'answer is:')[-1], 'answer:')[-1]"
    return f"trim({after}, chr(10) || ' .')"


def sql_letter(response: str, letters: str) -> str:
    cases = " ".join(f"when contains({response}, '{letter}') then '{letter}'" for letter in letters)
    marker = sql_marker(response)
    return f"case when length({marker}) <= 5 then {marker} {cases} else {marker} end"


def sql_exact(extracted: str, truth: str) -> str:
    return f"trim(lower({extracted}), '. ') = trim(lower(cast({truth} as varchar)), '. ')"


def sql_number(response: str) -> str:
    """The number rules one by one; lone numbers by splitting, since RE2 cannot look ahead."""
    number, space = f"({fixed.FLOAT_NUMBER})", fixed.SPACE
    stated = rf"{space}+(?:is|=){space}*{number}"
    leads = (
        rf"(?:the{space}+)?answer",
        rf"(?:the{space}+)?final{space}+(?:answer|result)",
        rf"(?:therefore|thus|so|hence),{space}+(?:the{space}+)?(?:answer|result)",
    )
    steps = [f"nullif(regexp_extract({response}, {text('(?i)' + lead + stated)}, 1), '')" for lead in leads]
    steps.append(f"regexp_extract_all({response}, {text(f'={space}*{number}')}, 1)[-1]")
    tokens = f"string_split_regex({response}, {text(space)})"
    steps.append(
        f"replace(list_filter({tokens}, lambda x: regexp_full_match(x, {text(fixed.GROUPED_NUMBER)}))[-1], ',', '')"
    )
    dollar = rf"\${space}*({fixed.DOLLAR_NUMBER})"
    steps.append(f"nullif(regexp_extract({response}, {text(dollar)}, 1), '')")
    # An empty response has the empty answer, no response has none.
    return f"case when {response} is not null then coalesce({', '.join(steps)}, '') end"


def sql_number_match(extracted: str, truth: str) -> str:
    key = f"replace(regexp_extract({truth}, {text(fixed.GROUPED_NUMBER)}), ',', '')"
    close = f"abs(try_cast({extracted} as double) - try_cast({key} as double)) < 1e-6"
    return f"case when {truth} is not null and {extracted} is not null then coalesce({close}, false) end"


def sql_first_brace_box(whole: str) -> str:
    return rf"regexp_extract_all({whole}, '\\boxed\{{(.+?)\}}', 1)[-1]"


def sql_balanced_box(whole: str) -> str:
    """The pieces up to the first closing brace behind which none is open."""
    pieces = f"string_split(string_split({whole}, chr(92) || 'boxed{{')[-1], '}}')"
    upto = f"array_to_string({pieces}[1:i], '}}')"
    ends = f"list_filter(generate_series(1, len({pieces}) - 1), lambda i: 1 + length({upto}) - length(replace({upto}, '{{', '')) - i = 0)"
    return f"case when contains({whole}, chr(92) || 'boxed{{') then nullif(array_to_string({pieces}[1:({ends})[1]], '}}'), '') end"


def sql_math_or_null(response: str, box: Callable[[str], str] = sql_first_brace_box) -> str:
    space_ends = rf"^{fixed.SPACE}+|{fixed.SPACE}+$"
    whole = f"regexp_replace({response}, {text(space_ends)}, '', 'g')"
    boxed = box(whole)
    lines = f"list_transform(string_split({whole}, chr(10)), lambda x: trim(x, ' .$'))"
    line = f"list_filter({lines}, lambda x: x <> '')[-1]"
    plain = f"regexp_full_match({line}, {text(f'(?:[a-zA-Z]|{fixed.SPACE})+')})"
    marked = rf"regexp_matches({line}, '[\p{{Nd}}=$()^]')"
    is_answer = f"length({line}) < 80 and not {plain} and ({marked} or length({line}) < 10)"
    return f"coalesce(trim({boxed}, ' $'), case when {is_answer} then {line} end)"


def sql_math(response: str, box: Callable[[str], str] = sql_first_brace_box) -> str:
    return f"coalesce({sql_math_or_null(response, box)}, '')"


def sql_math_match(extracted: str, truth: str, box: Callable[[str], str] = sql_first_brace_box) -> str:
    def plain(value: str) -> str:
        return f"trim(regexp_replace(lower({value}), {text(fixed.SPACE + '+')}, '', 'g'), ' .,$')"

    same = f"{extracted} <> '' and {plain(extracted)} = {plain(sql_math_or_null(truth, box))}"
    return f"case when {truth} is not null then coalesce({same}, false) end"


# --- views --------------------------------------------------------------------------------

MODEL = "concat('org/Model-', cast(l_linenumber as string), case l_linenumber % 3 when 0 then '-Instruct' when 1 then '-Chat-7.5' else '' end)"

# Letter questions of one benchmark; some parts have no truth.
CHOICE_ITEMS = """
select cast(p_partkey as string) as example_id, 'lukaemon/bbh' as dataset, 'test' as split, p_type as subset,
  p_name as prompt,
  case when p_size = 50 then null else concat('(', substr('ABCD', cast(1 + p_partkey % 4 as int), 1), ')') end as ground_truth
from {part}"""

_CHOICE_TEXT = """case kind
    when 0 then concat('Let me think. The answer is: (', letter, ').')
    when 1 then concat('Answer: (', letter, ')')
    when 2 then concat('answer: Z', chr(10), 'No wait, the Answer is: (', lower(letter), ')')
    when 3 then concat('(', letter, ')')
    when 4 then concat('I would pick option ', letter, ' over the others')
    else '' end"""

_LINES = f"""select l_partkey, l_orderkey, {MODEL} as model,
    (l_orderkey + l_linenumber) % 6 as kind, cast(l_quantity as int) as quantity,
    substr('ABCDE', cast(1 + (l_partkey + case when l_suppkey % 3 = 0 then 1 else 0 end) % 4 as int), 1) as letter
  from {{lineitem}}"""

CHOICE_RESPONSES = f"""
select cast(l_partkey as string) as example_id, 'lukaemon/bbh' as dataset, 'test' as split, model,
  {_CHOICE_TEXT} as response
from ({_LINES})"""

_NUMBER_TEXT = """case kind
    when 0 then concat('so the answer is ', n, ' in all')
    when 1 then concat('x = ', n, ' done')
    when 2 then concat('we get 1,', cast(100 + quantity as string), ' items')
    when 3 then concat('costs $ ', n, '.')
    when 4 then 'no idea'
    else concat('The answer is: ', n) end"""

_MATH_TEXT = """case kind
    when 0 then concat('so ', chr(92), 'boxed{{1}} and ', chr(92), 'boxed{{ ', n, ' }}')
    when 1 then concat('thus x', chr(10), 'x = ', n, '.')
    when 2 then 'I do not know this one'
    when 3 then concat(chr(92), 'boxed{{', chr(92), 'frac{{', n, '}}{{2}}}}')
    when 4 then concat('First.', chr(10), n, chr(10), ' $. ')
    else '' end"""

# Items and responses of six benchmarks at once, which need five ways of grading.
DATASET = """case {key} % 6 when 0 then 'lukaemon/bbh' when 1 then 'cais/mmlu' when 2 then 'allenai/ai2_arc'
    when 3 then 'openai/gsm8k' when 4 then 'DigitalLearningGmbH/MATH-lighteval' else 'TAUR-Lab/MuSR' end"""

MIXED_ITEMS = f"""
select cast(p_partkey as string) as example_id, {DATASET.replace('{key}', 'p_partkey')} as dataset, 'test' as split,
  p_type as subset, concat('What about ', p_name, '?') as prompt,
  case when p_size = 50 then null else
  case p_partkey % 6
    when 0 then concat('(', substr('ABCD', cast(1 + p_partkey % 4 as int), 1), ')')
    when 3 then concat('First ', cast(p_partkey % 50 as string), ' then more. #### ', cast(p_size * 3 as string))
    when 4 then concat('Work. ', chr(92), 'boxed{{{{', cast(p_partkey % 50 as string), '}}}}')
    else substr('ABCD', cast(1 + p_partkey % 4 as int), 1) end end as ground_truth
from {{part}}"""

MIXED_RESPONSES = f"""
select cast(l_partkey as string) as example_id, {DATASET.replace('{key}', 'l_partkey')} as dataset, 'test' as split,
  model,
  case l_partkey % 6 when 3 then {_NUMBER_TEXT} when 4 then {_MATH_TEXT} else {_CHOICE_TEXT} end as response
from (select *, cast(case when quantity > 25 then l_partkey % 50 else quantity end as string) as n from ({_LINES}))"""

# Number and math responses with their truths, row by row.
NUMBER_ROWS = f"""
select l_partkey, l_orderkey, concat('First ', cast(l_partkey % 50 as string), ' then more. #### 72') as ground_truth,
  case l_orderkey % 11 when 0 then '' when 1 then null else {_NUMBER_TEXT} end as response
from (select *, cast(case when quantity > 25 then l_partkey % 50 else quantity end as string) as n from ({_LINES}))"""

MATH_ROWS = f"""
select l_partkey, l_orderkey, concat('Work. ', chr(92), 'boxed{{{{', cast(l_partkey % 50 as string), '}}}}') as ground_truth,
  {_MATH_TEXT} as response
from (select *, cast(case when quantity > 25 then l_partkey % 50 else quantity end as string) as n from ({_LINES}))"""

# Whole documents as long responses, most of them with a last word.
DOCUMENT_RESPONSES = """
select doc_id, case doc_id % 5
    when 0 then concat(text, chr(10), 'The answer is: ', substr('ABCDE', cast(1 + doc_id % 5 as int), 1), '.')
    when 1 then concat('Answer: ', text)
    when 2 then concat(text, ' So, the result is ', cast(n_chars as string), '. ')
    when 3 then concat(text, chr(10), chr(92), 'boxed{{', lang, '}}')
    else text end as response
from {documents}"""


def sql_graded(rows: str) -> str:
    """Mixed benchmarks' rows with ``extracted_answer`` and ``is_correct``, as a subquery."""
    return f"""(select *, case dataset
        when 'openai/gsm8k' then {sql_number_match('extracted_answer', 'ground_truth')}
        when 'DigitalLearningGmbH/MATH-lighteval' then {sql_math_match('extracted_answer', 'ground_truth')}
        else {sql_exact('extracted_answer', 'ground_truth')} end as is_correct
      from (select *, case dataset
          when 'cais/mmlu' then {sql_letter('response', 'ABCD')}
          when 'allenai/ai2_arc' then {sql_letter('response', 'ABCDE')}
          when 'openai/gsm8k' then {sql_number('response')}
          when 'DigitalLearningGmbH/MATH-lighteval' then {sql_math('response')}
          else {sql_marker('response')} end as extracted_answer
        from {rows}))"""


SQL_MIXED_ROWS = f"""(select r.*, i.subset, i.prompt, i.ground_truth from {sql_view(MIXED_RESPONSES)} r
    join {sql_view(MIXED_ITEMS)} i using (dataset, split, example_id))"""

# Accuracy with null rows in the denominator, then counts.
SQL_ACCURACY = "cast(count(*) filter (where is_correct) as double) / count(*)"

SQL_RUNS = f"""(select model, dataset, split, count(*) as total_samples, {SQL_ACCURACY} as accuracy
    from {sql_graded(SQL_MIXED_ROWS)} group by model, dataset, split)"""
