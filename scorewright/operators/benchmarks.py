"""The supported benchmarks and their registry."""

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright import fixed
from scorewright.functions import options, truth
from scorewright.functions.prompts import or_placeholder
from scorewright.operators.adapter import Adapter
from scorewright.operators.grader import FINAL_NUMBER, MATH, MATH_BALANCED, NUMBER, letter_grader

AB, ABCD, ABCDE = tuple("AB"), tuple("ABCD"), tuple("ABCDE")
POSITIONS = ("0", "1", "2", "3")
SUFFIX_LINE = fixed.LETTER_SUFFIX + "\n"


def _text(*parts: Column | str) -> Column:
    """Concatenation of columns and literal strings."""
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _shown(name: str) -> Column:
    """A text of the prompt; a null prints as null option texts do."""
    return options.shown(F.col(name))


def _column(name: str):
    return lambda: F.col(name)


def _index_letter(name: str, letters: tuple[str, ...]):
    return lambda: truth.letter_by_map(F.col(name), range(len(letters)), letters)


def _with_label(table: DataFrame) -> DataFrame:
    """Truth letter from ``label``; a table without that column gets the error label."""
    letter = (
        truth.checked_letter(F.col("label"), ABCD) if "label" in table.columns else F.lit(fixed.LABEL_MISSING)
    )
    return table.withColumn("label_letter", letter)


def _with_shuffled_options(correct: str, distractors: tuple[str, ...], question: str):
    """The question, its four options in hash order, and the place of the correct one."""

    def prepare(table: DataFrame) -> DataFrame:
        columns = [F.col(f"`{name}`") for name in (correct, *distractors)]
        mixed = table.withColumn("shuffled", options.shuffled(columns, F.col("example_id")))
        return mixed.withColumn("position", options.position_label(F.col("shuffled"), F.col(f"`{correct}`"))).withColumn(
            "asked", F.col(f"`{question}`")
        )

    return prepare


def _shuffled_prompt() -> Column:
    return _text(
        "Question: ",
        _shown("asked"),
        "\n",
        fixed.CONTEXT_SUFFIX + "\n",
        options.numbered(F.col("shuffled"), parentheses=True),
    )


def _labelled(question: str) -> Column:
    lines = options.labelled_lookup(F.col("choices.label"), F.col("choices.text"))
    return _text(_shown(question), "\n", SUFFIX_LINE, lines)


def _passage_options(passage: str, question: str, option_list: Column) -> Column:
    # No line break before the suffix.
    return _text(_shown(passage), "\n", _shown(question), SUFFIX_LINE, options.lettered(option_list, ABCD))


LABELLED_CHOICES = "choices STRUCT<label: ARRAY<STRING>, text: ARRAY<STRING>>"

BBH = Adapter("lukaemon/bbh", "input STRING, target STRING", _column("input"), _column("target"))

# One JSON file, named by its path.
BBH_SYNTHETIC = Adapter(
    fixed.SYNTHETIC_SUFFIX,
    "problem STRING, answer STRING, metadata STRUCT<subset: STRING>",
    _column("problem"),
    _column("answer"),
    optional=("metadata",),
)

MMLU = Adapter(
    "cais/mmlu",
    "question STRING, choices ARRAY<STRING>, answer INT",
    lambda: _text(
        _shown("question"), "\n\n", options.lettered(F.col("choices"), ABCD), "\n", fixed.LETTER_SUFFIX
    ),
    lambda: truth.letter_by_list(F.col("answer"), ABCD),
    grader=letter_grader(ABCD),
    choices=ABCD,
    mapped_truth=True,
)

ARC = Adapter(
    "allenai/ai2_arc",
    f"question STRING, {LABELLED_CHOICES}, answerKey STRING",
    lambda: _text(
        _shown("question"),
        "\n\n",
        options.labelled_zip(F.col("choices.label"), F.col("choices.text")),
        "\n",
        fixed.LETTER_SUFFIX,
    ),
    _column("answerKey"),
    subset="ARC-Easy",
    grader=letter_grader(ABCDE),
    choices=ABCDE,
)

HELLASWAG = Adapter(
    "Rowan/hellaswag",
    "ctx STRING, endings ARRAY<STRING>, label STRING, ind INT",
    lambda: _text(
        _shown("ctx"),
        "\n\n",
        fixed.ENDING_LINE,
        options.lettered(F.col("endings"), ABCD),
        "\n",
        fixed.LETTER_SUFFIX,
    ),
    _column("label_letter"),
    split="validation",
    grader=letter_grader(ABCD),
    choices=ABCD,
    prepare=_with_label,
    optional=("label", "ind"),
)

WINOGRANDE = Adapter(
    "allenai/winogrande",
    "sentence STRING, option1 STRING, option2 STRING, answer STRING",
    lambda: _text(
        _shown("sentence"), "\n", options.lettered(F.array("option1", "option2"), AB), SUFFIX_LINE
    ),
    lambda: truth.letter_by_map(F.col("answer"), ("1", "2"), AB),
    split="validation",
    subset="winogrande_xl",
    choices=AB,
    mapped_truth=True,
)

COMMONSENSE_QA = Adapter(
    "tau/commonsense_qa",
    f"question STRING, {LABELLED_CHOICES}, answerKey STRING",
    lambda: _labelled("question"),
    _column("answerKey"),
    split="validation",
    choices=ABCDE,
)

OPENBOOK_QA = Adapter(
    "allenai/openbookqa",
    f"question_stem STRING, {LABELLED_CHOICES}, answerKey STRING",
    lambda: _labelled("question_stem"),
    _column("answerKey"),
    subset="main",
    choices=ABCD,
)

LOGIQA = Adapter(
    "lucasmccabe/logiqa",
    "context STRING, query STRING, options ARRAY<STRING>, correct_option INT",
    lambda: _passage_options("context", "query", F.col("options")),
    _index_letter("correct_option", ABCD),
    choices=ABCD,
    mapped_truth=True,
)

MUSR = Adapter(
    "TAUR-Lab/MuSR",
    "narrative STRING, question STRING, choices STRING, answer_index INT, answer_choice STRING",
    lambda: _passage_options("narrative", "question", options.parse_list(F.col("choices"))),
    _index_letter("answer_index", ABCD),
    split="murder_mysteries",
    choices=ABCD,
    optional=("answer_choice",),
    mapped_truth=True,
)

MATH_QA = Adapter(
    "allenai/math_qa",
    "Problem STRING, options STRING, correct STRING, Rationale STRING, annotated_formula STRING, "
    "category STRING, linear_formula STRING",
    lambda: _text(_shown("Problem"), "\n", SUFFIX_LINE, options.relabel_packed(F.col("options")), "\n"),
    lambda: truth.capitalized(F.col("correct")),
    choices=AB,
    optional=("Rationale", "annotated_formula", "category", "linear_formula"),
)

PIQA = Adapter(
    "ybisk/piqa",
    "goal STRING, sol1 STRING, sol2 STRING, label INT",
    lambda: _text(
        _shown("goal"), "\n", SUFFIX_LINE, "A: ", _shown("sol1"), "\n", "B: ", _shown("sol2"), "\n"
    ),
    _index_letter("label", AB),
    split="train",
    choices=AB,
    mapped_truth=True,
)

NEQA = Adapter(
    "inverse-scaling/NeQA",
    "prompt STRING, answer_index INT, classes ARRAY<STRING>",
    lambda: _text(_shown("prompt"), "\n", SUFFIX_LINE),
    _index_letter("answer_index", AB),
    split="train",
    choices=AB,
    optional=("classes",),
    mapped_truth=True,
)

QUALITY = Adapter(
    "emozilla/quality",
    "article STRING, question STRING, options ARRAY<STRING>, answer INT",
    lambda: _text(
        "Context",
        _shown("article"),
        "\n",
        "Question: ",
        _shown("question"),
        "\n",
        fixed.CONTEXT_SUFFIX + "\n",
        options.numbered(F.col("options")),
    ),
    _column("answer"),
    split="validation",
    choices=POSITIONS,
)

GPQA = Adapter(
    "Idavidrein/gpqa",
    "Question STRING, `Correct Answer` STRING, `Incorrect Answer 1` STRING, `Incorrect Answer 2` STRING, "
    "`Incorrect Answer 3` STRING",
    _shuffled_prompt,
    _column("position"),
    split="train",
    subset="gpqa_main",
    choices=POSITIONS,
    prepare=_with_shuffled_options(
        "Correct Answer", ("Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3"), "Question"
    ),
)

SCIQ = Adapter(
    "allenai/sciq",
    "question STRING, correct_answer STRING, distractor1 STRING, distractor2 STRING, distractor3 STRING",
    _shuffled_prompt,
    _column("position"),
    choices=POSITIONS,
    prepare=_with_shuffled_options("correct_answer", ("distractor1", "distractor2", "distractor3"), "question"),
)

DROP = Adapter(
    "ucinlp/drop",
    "passage STRING, question STRING, answers_spans STRUCT<spans: ARRAY<STRING>>",
    lambda: _text("Context", _shown("passage"), "\n", "Question: ", _shown("question")),
    lambda: truth.first_span(F.col("answers_spans.spans")),
    split="validation",
    mapped_truth=True,
)

GSM8K = Adapter(
    "openai/gsm8k",
    "question STRING, answer STRING",
    lambda: _text(
        or_placeholder(F.col("question"), fixed.MISSING_QUESTION), "\n\n", fixed.GSM8K_INSTRUCTION
    ),
    _column("answer"),
    subset="main",
    grader=NUMBER,
    instruction=None,
    optional=("question",),
)

MATH_LIGHTEVAL = Adapter(
    "DigitalLearningGmbH/MATH-lighteval",
    "problem STRING, solution STRING",
    lambda: _text(
        or_placeholder(F.col("problem"), fixed.MISSING_PROBLEM), "\n\n", fixed.MATH_INSTRUCTION
    ),
    _column("solution"),
    subset="default",
    grader=MATH,
    instruction=None,
    optional=("problem",),
)

# As GSM8K, but the truth is the number after "####" with all its digits.
GSM8K_FINAL_NUMBER = replace(GSM8K, grader=FINAL_NUMBER)

# As MATH_LIGHTEVAL, with whole boxes also where braces stand in them.
MATH_BALANCED_BOXES = replace(MATH_LIGHTEVAL, grader=MATH_BALANCED)

REGISTRY: dict[str, Adapter] = {
    adapter.name: adapter
    for adapter in (
        COMMONSENSE_QA,
        NEQA,
        WINOGRANDE,
        BBH,
        MMLU,
        HELLASWAG,
        ARC,
        GSM8K,
        MATH_LIGHTEVAL,
        BBH_SYNTHETIC,
        DROP,
        OPENBOOK_QA,
        GPQA,
        QUALITY,
        SCIQ,
        LOGIQA,
        MUSR,
        PIQA,
        MATH_QA,
    )
}


def get_adapter(dataset: str) -> Adapter:
    """Adapter of a dataset name, or of the path of a synthetic JSON file."""
    if dataset in REGISTRY:
        return REGISTRY[dataset]
    if dataset.endswith(fixed.SYNTHETIC_SUFFIX):
        return replace(BBH_SYNTHETIC, name=dataset)
    raise ValueError(f"Dataset {dataset} not supported")
