"""Prompts and truths of every benchmark on literal rows, and the option and truth functions' edge cases."""

import pytest
from pyspark.sql import functions as F

from scorewright import fixed, get_adapter
from scorewright.functions import options, prompts, truth
from scorewright.operators import benchmarks
from scorewright.operators.adapter import keyed_adapter
from scorewright.operators.items import build_items

LEAD = 'Let\'s think step by step and output the final answer after "The answer is:".\n '
LETTERS = "Choose the correct option from the following options (for final answer, please only output the letter choice): "
CONTEXT = (
    "Based on the givencontext, choose the correct option for the question from the following options "
    "(for final answer, please only output the letter choice): \n"
)

CASES = [
    ("lukaemon/bbh", ["Is it?", "(B)"], LEAD + "Is it?", "(B)", "test"),
    ("data/x_bbh_syn_all.json", ["P", "A", None], LEAD + "P", "A", "test"),
    ("cais/mmlu", ["Q", ["w", "x", "y", "z"], 2], LEAD + "Q\n\nA. w\nB. x\nC. y\nD. z\n\n" + LETTERS, "C", "test"),
    ("allenai/ai2_arc", ["Q", (["1", "2", "3"], ["x", "y"]), "2"], LEAD + "Q\n\n1. x\n2. y\n\n" + LETTERS, "2", "test"),
    (
        "Rowan/hellaswag",
        ["He", ["a", "b"], " 3 ", 7],
        LEAD + "He\n\nChoose the most appropriate ending for the above text:\nA. a\nB. b\n\n" + LETTERS,
        "D",
        "validation",
    ),
    ("allenai/winogrande", ["S _", "x", "y", "2"], LEAD + "S _\nA. x\nB. y\n" + LETTERS + "\n", "B", "validation"),
    ("tau/commonsense_qa", ["Q", (["A", "B"], ["x", "y"]), "B"], LEAD + "Q\n" + LETTERS + "\nA. x\nB. y\n", "B", "validation"),
    ("allenai/openbookqa", ["Q", (["A", "B"], ["x", "y"]), "A"], LEAD + "Q\n" + LETTERS + "\nA. x\nB. y\n", "A", "test"),
    ("lucasmccabe/logiqa", ["C", "Q", ["x", "y"], 1], LEAD + "C\nQ" + LETTERS + "\nA. x\nB. y\n", "B", "test"),
    (
        "TAUR-Lab/MuSR",
        ["N", "Who?", "['Mac', \"O'Neil\"]", 0, "Mac"],
        LEAD + "N\nWho?" + LETTERS + "\nA. Mac\nB. O'Neil\n",
        "A",
        "murder_mysteries",
    ),
    (
        "allenai/math_qa",
        ["P", "a ) six , b ) 9 km", "c", None, None, None, None],
        LEAD + "P\n" + LETTERS + "\nA.  six , B.  9 km\n",
        "C",
        "test",
    ),
    ("ybisk/piqa", ["G", "x", "y", 1], LEAD + "G\n" + LETTERS + "\nA: x\nB: y\n", "B", "train"),
    ("inverse-scaling/NeQA", ["P", 0, [" A", " B"]], LEAD + "P\n" + LETTERS + "\n", "A", "train"),
    (
        "emozilla/quality",
        ["Art", "Q", ["x", "y"], 1],
        LEAD + "ContextArt\nQuestion: Q\n" + CONTEXT + "0.x\n1.y\n",
        "1",
        "validation",
    ),
    ("ucinlp/drop", ["Pa", "Q", (["s1", "s2"],)], LEAD + "ContextPa\nQuestion: Q", "s1", "validation"),
    (
        "openai/gsm8k",
        ["How many?", "#### 3"],
        "How many?\n\nSolve the following math word problem step by step. Think carefully and break down the problem. "
        "Make sure to include the final numerical answer after 'The answer is:'",
        "#### 3",
        "test",
    ),
    (
        "DigitalLearningGmbH/MATH-lighteval",
        ["", "s"],
        "[Problem text not found or empty]\n\nSolve the following math problem step by step. Think step-by-step to reach "
        "the solution. Present the final numerical or symbolic answer enclosed in \\boxed{}. The final answer should be "
        "the only thing within the \\boxed{}.",
        "s",
        "test",
    ),
]


@pytest.mark.parametrize("name, row, prompt, ground_truth, split", CASES)
def test_items(spark, name, row, prompt, ground_truth, split):
    adapter = get_adapter(name)
    table = spark.createDataFrame([tuple(row)], adapter.schema).withColumn("example_id", F.lit(5))
    item = build_items(table, adapter).first()
    assert item.prompt == prompt
    assert item.ground_truth == ground_truth
    assert (item.example_id, item.dataset, item.split, item.subset) == ("5", name, split, "unknown")


@pytest.mark.parametrize("adapter", [benchmarks.GPQA, benchmarks.SCIQ])
def test_shuffled_items(spark, adapter):
    rows = [(f"q{i}", "right", "w1", "w2", "w3") for i in range(200)]
    table = spark.createDataFrame(rows, adapter.schema).withColumn("example_id", F.col(adapter.schema.names[0]))
    items = build_items(table, adapter).collect()
    for item in items:
        lines = item.prompt.split(CONTEXT)[1].splitlines()
        assert sorted(line.split(".")[1] for line in lines) == ["right", "w1", "w2", "w3"]
        assert lines[int(item.ground_truth[1:-1])] == f"{item.ground_truth}.right"
    places = [item.ground_truth for item in items]
    assert all(30 < places.count(f"({i})") < 70 for i in range(4))
    other_order = build_items(table.repartition(7), adapter).collect()
    assert sorted(other_order) == sorted(items)


def test_registry():
    assert len(benchmarks.REGISTRY) == 19
    assert get_adapter("some/where/bbh_syn_all.json").name == "some/where/bbh_syn_all.json"
    with pytest.raises(ValueError, match="not supported"):
        get_adapter("no/such")


def test_missing_columns(spark):
    table = spark.createDataFrame([("1", "c", ["a"])], "example_id STRING, ctx STRING, endings ARRAY<STRING>")
    assert build_items(table, benchmarks.HELLASWAG).first().ground_truth == fixed.LABEL_MISSING
    answers = spark.createDataFrame([("1", "#### 5")], "example_id STRING, answer STRING")
    assert build_items(answers, benchmarks.GSM8K).first().prompt.startswith("[Question text not found or empty]\n\n")
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        build_items(answers, benchmarks.BBH)


def test_keyed_prompt(spark):
    table = spark.createDataFrame([("q", "o", "h", "t")], "q STRING, o STRING, h STRING, t STRING")

    def prompt(keys):
        adapter = keyed_adapter("own", keys, "t", instruction=None)
        return build_items(table, adapter, example_id=F.lit("1")).first().prompt

    assert prompt(["q"]) == "q"
    assert prompt(["q", "o", "h"]) == "q\nChoose the correct option from the following options: \no\nh"


def test_subset_of_metadata(spark):
    table = spark.sql("select '1' as example_id, 'p' as problem, 'a' as answer, named_struct('subset', 's') as metadata")
    assert build_items(table, "x/bbh_syn_all.json").first().subset == "s"
    assert build_items(table.withColumn("subset", F.lit("t")), "x/bbh_syn_all.json").first().subset == "t"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_options(spark):
    two = F.array(F.lit("x"), F.lit(None))
    assert one(spark, options.lettered(two, "AB")) == "A. x\nB. None\n"
    assert one(spark, options.lettered(two, "A")) is None
    with pytest.raises(Exception, match="more than 1 options"):
        one(spark, options.lettered(two, "A", strict=True))
    labels = F.array(*map(F.lit, "ABC"))
    assert one(spark, options.labelled_zip(labels, two)) == "A. x\nB. None\n"
    assert one(spark, options.labelled_lookup(labels, two)) is None
    with pytest.raises(Exception, match="fewer option texts"):
        one(spark, options.labelled_lookup(labels, two, strict=True))
    assert one(spark, options.numbered(two)) == "0.x\n1.None\n"
    assert one(spark, options.parse_list(F.lit("['it\\'s', \"b\"]"))) == ["it's", "b"]
    assert one(spark, options.relabel_packed(F.lit("a ) data ) x"))) == "A.  datA.  x"
    repeated = options.shuffled([F.lit("x"), F.lit("x"), F.lit("z"), F.lit("w")], F.lit("k"))
    mixed = one(spark, repeated)
    assert one(spark, options.position_label(repeated, F.lit("x"))) == f"({mixed.index('x')})"


def test_truths(spark):
    assert [one(spark, truth.letter_by_list(F.lit(i), "ABCD")) for i in (0, 3, -1, -4, 4, -5)] == ["A", "D", "D", "A", None, None]
    assert one(spark, truth.letter_by_map(F.lit("2"), ("1", "2"), "AB")) == "B"
    assert one(spark, truth.letter_by_map(F.lit(5), range(4), "ABCD")) is None
    with pytest.raises(Exception, match="no answer for label 5"):
        one(spark, truth.letter_by_map(F.lit(5), range(4), "ABCD", strict=True))
    labels = ["0", " 3 ", "4", "", "3.0", None, "-1"]
    expected = ["A", "D", fixed.LABEL_OUT_OF_BOUNDS, *[fixed.LABEL_INVALID] * 3, fixed.LABEL_OUT_OF_BOUNDS]
    assert [one(spark, truth.checked_letter(F.lit(label).cast("string"), "ABCD")) for label in labels] == expected
    assert [one(spark, truth.capitalized(F.lit(word))) for word in ("c", "bIG words", "")] == ["C", "Big words", ""]


def test_chat(spark):
    names = ["org/Model-Instruct", "org/CHATTY", "org/base"]
    assert [one(spark, prompts.is_chat_model(F.lit(name))) for name in names] == [True, True, False]
    messages = one(spark, prompts.chat_messages(F.lit("hi")))
    assert [(m.role, m.content) for m in messages] == [("system", fixed.SYSTEM_PROMPT), ("user", "hi")]


@pytest.mark.parametrize(
    "dataset, row",
    [
        ("cais/mmlu", ["Q", ["v", "w", "x", "y", "z"], 2]),
        ("cais/mmlu", ["Q", ["v"], 9]),
        ("tau/commonsense_qa", ["Q", (["A", "B"], ["x"]), "A"]),
        ("lucasmccabe/logiqa", ["C", "Q", ["x"], 4]),
        ("ybisk/piqa", ["G", "x", "y", 2]),
        ("allenai/winogrande", ["S", "x", "y", "3"]),
        ("ucinlp/drop", ["P", "Q", ([],)]),
    ],
)
def test_strict_items(spark, dataset, row):
    adapter = get_adapter(dataset)
    table = spark.createDataFrame([tuple(row)], adapter.schema).withColumn("example_id", F.lit("7"))
    with pytest.raises(Exception, match=f"{dataset}: no (prompt|answer) for item 7"):
        build_items(table, adapter).collect()
    item = build_items(table, adapter, strict=False).first()
    assert item.prompt is None or item.ground_truth is None


def test_null_texts_print(spark):
    for dataset, row in (("ybisk/piqa", ["G", None, "y", 0]), ("allenai/ai2_arc", [None, (["A"], ["x"]), "A"]), ("Rowan/hellaswag", [None, ["x"], "0", 1])):
        adapter = get_adapter(dataset)
        table = spark.createDataFrame([tuple(row)], adapter.schema).withColumn("example_id", F.lit("7"))
        assert "None" in build_items(table, adapter).first().prompt


def test_keys_with_dots_and_labels_out_of_range(spark):
    own = keyed_adapter("own/x", ["a.b", "c"], "d.e")
    table = spark.createDataFrame([("p", "q", "t", "1")], "`a.b` string, c string, `d.e` string, example_id string")
    assert build_items(table, own).first().ground_truth == "t"
    labels = spark.createDataFrame([(x,) for x in ("2147483648", " 3 ", "3.0", "", "-1", "9" * 30, None)], "l string")
    found = [r[0] for r in labels.select(truth.checked_letter(F.col("l"), "ABCD")).collect()]
    out, bad = "ERROR_LABEL_OUT_OF_BOUNDS", "ERROR_INVALID_LABEL"
    assert found == [out, "D", bad, bad, out, out, bad]
