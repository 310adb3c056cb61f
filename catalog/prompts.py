"""Items of every benchmark: its input table made from the test tables, its prompts and truths."""

from pyspark.sql import functions as F

from catalog.inputs import Query, joined, table, text
from scorewright import fixed
from scorewright.functions.prompts import chat_messages, is_chat_model
from scorewright.operators import benchmarks
from scorewright.operators.adapter import keyed_adapter
from scorewright.operators.items import build_items, with_content_id

NL = text("\n")
SUFFIX = text(fixed.LETTER_SUFFIX)
SUFFIX_LINE = text(fixed.LETTER_SUFFIX + "\n")
CONTEXT_LINE = text(fixed.CONTEXT_SUFFIX + "\n")
LETTER = "substr('ABCD', cast(p_partkey % 4 as integer) + 1, 1)"
AB_LETTER = "substr('AB', cast(p_partkey % 2 as integer) + 1, 1)"


def option_lines(*options: str, label=lambda i: "ABCDE"[i] + ". ") -> str:
    return joined(*[joined(text(label(i)), option, NL) for i, option in enumerate(options)])


def items_query(name, ids, adapter, source, columns, prompt, truth, split, subset, key):
    """Items of an adapter against the prompt and truth written in SQL over the same table."""
    inputs = [f"{key} as example_id", *columns]
    if adapter.instruction is not None:
        prompt = joined(text(adapter.instruction + "\n "), prompt)

    def run(spark, folder):
        # The rows of MuSR have labels outside its map, which are to give a null truth here.
        return build_items(table(spark, folder, source).selectExpr(*inputs), adapter, strict=adapter is not benchmarks.MUSR)

    sql = f"""select cast({key} as varchar) as example_id, {text(adapter.name)} as dataset, {text(split)} as split,
      {subset} as subset, {prompt} as prompt, {truth} as ground_truth from {source}"""
    return Query(name, ids, run, sql)


def part_items(name, ids, adapter, columns, prompt, truth, split="test", subset="p_type"):
    inputs = [*columns, "p_type as subset"] if subset == "p_type" else columns
    return items_query(name, ids, adapter, "part", inputs, prompt, truth, split, subset, "p_partkey")


def document_items(name, ids, adapter, columns, prompt, truth, split, subset="source"):
    return items_query(name, ids, adapter, "documents", [*columns, "source as subset"], prompt, truth, split, subset, "doc_id")


FOUR = ("p_name", "p_brand", "p_type", "'none'")
FOUR_ARRAY = "array(p_name, p_brand, p_type, 'none')"
FOUR_LABELLED = f"named_struct('label', array('A', 'B', 'C', 'D'), 'text', {FOUR_ARRAY}) as choices"
DOC_LETTER = "substr('ABCD', cast(doc_id % 4 as integer) + 1, 1)"
DOC_OPTIONS = ("lang", "source", "'neither'")


def shuffled_sql(key: str, options: tuple[str, ...]) -> str:
    entries = ", ".join(f"{{'o': md5('42|' || {key} || '|{i}'), 't': {option}}}" for i, option in enumerate(options))
    return f"list_transform(list_sort([{entries}]), lambda s: s.t)"


SHUFFLED = shuffled_sql("p_partkey", ("p_name", "p_brand", "p_type", "'none'"))
SHUFFLED_LINES = f"array_to_string(list_transform({SHUFFLED}, lambda x, i: concat('(', i - 1, ').', x, chr(10))), '')"
SHUFFLED_PROMPT = joined("'Question: '", "p_brand", NL, CONTEXT_LINE, SHUFFLED_LINES)
SHUFFLED_TRUTH = f"'(' || (list_position({SHUFFLED}, p_name) - 1) || ')'"

HELLASWAG_LABEL = "case cast(p_partkey % 7 as int) when 4 then '4' when 5 then '' when 6 then ' 3 ' else cast(p_partkey % 7 as string) end"
HELLASWAG_TRUTH = """case p_partkey % 7 when 4 then 'ERROR_LABEL_OUT_OF_BOUNDS' when 5 then 'ERROR_INVALID_LABEL'
    when 6 then 'D' else substr('ABCD', cast(p_partkey % 7 as integer) + 1, 1) end"""

CATEGORY_KEYED = keyed_adapter("own/parts", ["p_name", "p_brand", "p_type"], "p_category", split="dev")


def keyed_items(spark, folder):
    parts = table(spark, folder, "part").withColumn("p_category", F.col("p_size") % 10)
    return build_items(parts, CATEGORY_KEYED, example_id="p_partkey")


def unkeyed_items(spark, folder):
    """Documents without their id: of equal rows each is an item."""
    texts = table(spark, folder, "documents").select(F.col("text").alias("input"), F.col("lang").alias("target"))
    return build_items(with_content_id(texts), benchmarks.BBH).select("dataset", "prompt", "ground_truth")


def chat_prompts(spark, folder):
    """System and user message for every turn, when the asked model takes messages."""
    turns = table(spark, folder, "conversations")
    model = F.concat(F.lit("org/Model-"), F.element_at(F.array(*map(F.lit, ("base", "Chat", "INSTRUCT"))), (F.col("turn") % 3 + 1).cast("int")))
    asked = turns.withColumn("model", model).where(is_chat_model(F.col("model")))
    return asked.select("conv_id", "turn", "model", F.posexplode(chat_messages(F.col("text")))).select(
        "conv_id", "turn", "model", F.col("pos").alias("position"), "col.role", "col.content"
    )


QUERIES = [
    document_items("items_bbh", ("PRJ2", "PRJ22", "GT1"), benchmarks.BBH,
                   ["text as input", "lang as target"], "text", "lang", "test"),
    document_items("items_bbh_synthetic", ("PRJ3", "PRD1", "GT1"), benchmarks.BBH_SYNTHETIC,
                   ["text as problem", "lang as answer"], "text", "lang", "test"),
    part_items("items_mmlu", ("PRJ4", "GT2", "OPT1"), benchmarks.MMLU,
               ["p_brand as question", f"{FOUR_ARRAY} as choices", "cast(p_partkey % 4 as int) as answer"],
               joined("p_brand", NL, NL, option_lines(*FOUR), NL, SUFFIX), LETTER),
    part_items("items_arc", ("PRJ5", "GT1", "OPT2"), benchmarks.ARC,
               ["p_brand as question",
                f"named_struct('label', array('1', '2', '3', '4', '5'), 'text', {FOUR_ARRAY}) as choices",
                "cast(p_partkey % 4 + 1 as string) as answerKey"],
               joined("p_brand", NL, NL, option_lines(*FOUR, label=lambda i: f"{i + 1}. "), NL, SUFFIX),
               "cast(p_partkey % 4 + 1 as varchar)"),
    part_items("items_hellaswag", ("PRJ6", "GT6", "OPT1"), benchmarks.HELLASWAG,
               ["p_brand as ctx", f"{FOUR_ARRAY} as endings", f"{HELLASWAG_LABEL} as label", "p_size as ind"],
               joined("p_brand", NL, NL, text(fixed.ENDING_LINE), option_lines(*FOUR), NL, SUFFIX),
               HELLASWAG_TRUTH, "validation"),
    part_items("items_winogrande", ("PRJ7", "GT5"), benchmarks.WINOGRANDE,
               ["p_type as sentence", "p_name as option1", "p_brand as option2", "cast(p_partkey % 2 + 1 as string) as answer"],
               joined("p_type", NL, option_lines("p_name", "p_brand"), SUFFIX_LINE), AB_LETTER, "validation"),
    part_items("items_commonsense_qa", ("PRJ8", "GT10", "OPT3"), benchmarks.COMMONSENSE_QA,
               ["p_brand as question", FOUR_LABELLED, "substr('ABCD', cast(p_partkey % 4 as int) + 1, 1) as answerKey"],
               joined("p_brand", NL, SUFFIX_LINE, option_lines(*FOUR)), LETTER, "validation"),
    part_items("items_openbook_qa", ("PRJ9", "GT1", "OPT3"), benchmarks.OPENBOOK_QA,
               ["p_brand as question_stem", FOUR_LABELLED, "substr('ABCD', cast(p_partkey % 4 as int) + 1, 1) as answerKey"],
               joined("p_brand", NL, SUFFIX_LINE, option_lines(*FOUR)), LETTER),
    document_items("items_logiqa", ("PRJ10", "GT3", "OPT1"), benchmarks.LOGIQA,
                   ["text as context", "concat('In ', lang, '?') as query", "array(lang, source, 'neither') as options",
                    "cast(doc_id % 4 as int) as correct_option"],
                   joined("text", NL, "'In '", "lang", "'?'", SUFFIX_LINE, option_lines(*DOC_OPTIONS)), DOC_LETTER, "test"),
    document_items("items_musr", ("PRJ11", "GT3", "OPT4"), benchmarks.MUSR,
                   ["text as narrative", "'Who?' as question", "concat('[\\'', lang, '\\', \"', source, '\"]') as choices",
                    "cast(doc_id % 5 as int) as answer_index"],
                   joined("text", NL, "'Who?'", SUFFIX_LINE, option_lines("lang", "source")),
                   "case when doc_id % 5 < 4 then substr('ABCD', cast(doc_id % 5 as integer) + 1, 1) end",
                   "murder_mysteries"),
    part_items("items_math_qa", ("PRJ12", "GT8", "OPT5"), benchmarks.MATH_QA,
               ["p_name as Problem", "concat('a ) ', p_brand, ' , b ) ', p_type, ' , c ) 5 , d ) 6 , e ) 7') as options",
                "substr('abcde', cast(p_partkey % 5 as int) + 1, 1) as correct"],
               joined("p_name", NL, SUFFIX_LINE, "'A.  '", "p_brand", "' , B.  '", "p_type", "' , C.  5 , D.  6 , E.  7'", NL),
               "substr('ABCDE', cast(p_partkey % 5 as integer) + 1, 1)"),
    part_items("items_piqa", ("PRJ13", "GT4"), benchmarks.PIQA,
               ["p_type as goal", "p_name as sol1", "p_brand as sol2", "cast(p_partkey % 2 as int) as label"],
               joined("p_type", NL, SUFFIX_LINE, "'A: '", "p_name", NL, "'B: '", "p_brand", NL), AB_LETTER, "train"),
    part_items("items_neqa", ("PRJ14", "GT4"), benchmarks.NEQA,
               ["p_name as prompt", "cast(p_partkey % 2 as int) as answer_index"],
               joined("p_name", NL, SUFFIX_LINE), AB_LETTER, "train"),
    document_items("items_quality", ("PRJ15", "GT1", "OPT6"), benchmarks.QUALITY,
                   ["text as article", "source as question", "array(lang, source, 'neither') as options",
                    "cast(doc_id % 3 as int) as answer"],
                   joined("'Context'", "text", NL, "'Question: '", "source", NL, CONTEXT_LINE,
                          option_lines(*DOC_OPTIONS, label=lambda i: f"{i}.")),
                   "cast(doc_id % 3 as varchar)", "validation"),
    part_items("items_gpqa", ("PRJ16", "GT9", "OPT7", "OPT8", "OPT9"), benchmarks.GPQA,
               ["p_brand as Question", "p_name as `Correct Answer`", "p_brand as `Incorrect Answer 1`",
                "p_type as `Incorrect Answer 2`", "'none' as `Incorrect Answer 3`"],
               SHUFFLED_PROMPT, SHUFFLED_TRUTH, "train"),
    part_items("items_sciq", ("PRJ17", "GT9", "OPT7", "OPT8", "OPT9"), benchmarks.SCIQ,
               ["p_brand as question", "p_name as correct_answer", "p_brand as distractor1", "p_type as distractor2",
                "'none' as distractor3"],
               SHUFFLED_PROMPT, SHUFFLED_TRUTH, "test"),
    document_items("items_drop", ("PRJ18", "GT7"), benchmarks.DROP,
                   ["text as passage", "lang as question", "named_struct('spans', split(text, ' ')) as answers_spans"],
                   joined("'Context'", "text", NL, "'Question: '", "lang"), "string_split(text, ' ')[1]", "validation"),
    part_items("items_gsm8k", ("PRJ19", "PRJ21", "PRJ24", "GT1"), benchmarks.GSM8K,
               ["case p_partkey % 3 when 0 then p_name when 1 then '' end as question",
                "concat('#### ', cast(p_size as string)) as answer"],
               joined(f"case p_partkey % 3 when 0 then p_name else {text(fixed.MISSING_QUESTION)} end", NL, NL,
                      text(fixed.GSM8K_INSTRUCTION)),
               "'#### ' || p_size"),
    part_items("items_math", ("PRJ20", "PRJ21", "PRJ24", "GT1"), benchmarks.MATH_LIGHTEVAL,
               ["case p_partkey % 3 when 0 then p_name when 1 then '' end as problem",
                "concat('It is ', cast(p_size as string)) as solution"],
               joined(f"case p_partkey % 3 when 0 then p_name else {text(fixed.MISSING_PROBLEM)} end", NL, NL,
                      text(fixed.MATH_INSTRUCTION)),
               "'It is ' || p_size"),
    Query("items_by_keys", ("PRJ1", "PRJ22", "GT1", "PRD1"), keyed_items,
          f"""select cast(p_partkey as varchar) as example_id, 'own/parts' as dataset, 'dev' as split, 'unknown' as subset,
            {joined(text(fixed.INSTRUCTION + '''
 '''), 'p_name', NL, text(fixed.KEYED_OPTIONS_LINE), 'p_brand', NL, 'p_type')} as prompt,
            cast(p_size % 10 as varchar) as ground_truth from part"""),
    Query("items_without_key", ("PRJ2", "UDF1"), unkeyed_items,
          f"""select 'lukaemon/bbh' as dataset, {joined(text(fixed.INSTRUCTION + '''
 '''), 'text')} as prompt, lang as ground_truth from documents"""),
    Query("chat_prompts", ("PRJ23", "FLT1"), chat_prompts,
          f"""select conv_id, turn, 'org/Model-' || case turn % 3 when 1 then 'Chat' else 'INSTRUCT' end as model,
            position, role, content
          from (select conv_id, turn, 0 as position, 'system' as role, {text(fixed.SYSTEM_PROMPT)} as content
                from conversations union all select conv_id, turn, 1, 'user', text from conversations)
          where turn % 3 > 0"""),
]
