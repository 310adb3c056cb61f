"""Extraction and correctness against literal rows, and against texts composed around a known answer."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from scorewright import fixed
from scorewright.functions import correct, extract, text
from scorewright.operators.grader import FINAL_NUMBER, MATH, NUMBER


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i INT, r STRING")
    return [row[0] for row in rows.orderBy("i").select(make(F.col("r"))).collect()]


def test_space_class_is_pythons(spark):
    codes = spark.range(sys.maxunicode + 1).where("id < 55296 or id > 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    found = codes.where(char.rlike(rf"\A{fixed.SPACE}\z")).agg(F.collect_list("id")).first()[0]
    assert sorted(found) == [c for c in range(sys.maxunicode + 1) if chr(c).isspace()]


@pytest.mark.parametrize(
    "response, answer",
    [
        ("The answer is: (B).", "(b)"),
        ("answer: x\nAnswer is: y .", "y"),
        ("No marker here.", "no marker here"),
        ("", ""),
        ("Answer is: a answer: b", "b"),
        ("ANSWER IS: \n\n C \n.", "c"),
    ],
)
def test_after_marker(spark, response, answer):
    assert column(spark, [response], extract.after_marker) == [answer]


def test_after_marker_composed(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(2000):
        wanted = rng.choice(["b", "two words", "ü", "x: y", "(c)"])
        before = "".join(rng.choice(["answer ", "Answer:", "is: ", "ß.", "ANSWER IS: no ", "\n"]) for _ in range(rng.randrange(5)))
        rows.append((f"{before}{rng.choice(['answer:', 'Answer Is:'])} .\n{wanted.upper()}{rng.choice(['', '.', ' . \n'])}", wanted))
    got = column(spark, [text for text, _ in rows], extract.after_marker)
    assert [(t, w, g) for (t, w), g in zip(rows, got) if g != w] == []


@pytest.mark.parametrize(
    "response, answer",
    [
        ("Because C is right", "B"),
        ("And so it is option D", "A"),
        ("none of these", "none of these"),
        ("The answer is: b.", "b"),
        ("Answer: 12345", "12345"),
    ],
)
def test_letter_or_marker(spark, response, answer):
    assert column(spark, [response], lambda r: extract.letter_or_marker(r, "ABCD")) == [answer]


@pytest.mark.parametrize(
    "response, answer",
    [
        ("The answer is: 42", "42"),
        ("the answer is 1,234", "1"),
        ("total = 3 = 7", "7"),
        ("we get 1,234 items", "1234"),
        ("it costs $ 7.", "7"),
        ("no number", ""),
        ("", ""),
        ("the final result is -3.5e2 and 9", "-3.5e2"),
        ("So, the result = .5!", ".5"),
        ("ANSWER\u00a0IS 5", "5"),
        ("answer is 8, answer is 9", "8"),
        ("a 1234 b", "1234"),
        ("7", "7"),
        ("7\n", "7"),
    ],
)
def test_number_answer(spark, response, answer):
    assert column(spark, [response], extract.number_answer) == [answer]


NUMBERS = ["7", "-3", "+12", "0.5", ".25", "6e3", "-1.5E-2"]
NOISE = ["so we look on", "the sum grows", "nothing here", "x and y;", "\u00a0", "\n", "ſtep"]


def composed_numbers(seed, count):
    """Texts around a chosen number: (text, the number that the rules have to find)."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        noise = lambda: " ".join(rng.choice(NOISE) for _ in range(rng.randrange(4)))
        wanted, other = rng.choice(NUMBERS), rng.choice(NUMBERS)
        stated = rng.choice(["answer is {}", "The ANSWER = {}", "the final\tresult is {}", "final answer is {}", "Thus, the result is {}", "hence, answer = {}"])
        way = rng.randrange(4)
        if way == 0:  # A stated answer comes before all else; of several of one kind the first.
            text = f"{noise()} y = {other} {noise()} {stated.format(wanted)} ! {noise()} $ {other} then"
        elif way == 1:  # Without one, the last number behind an equals sign.
            text = f"{noise()} a = {other} {noise()} b ={wanted} c {noise()} 99 !"
        elif way == 2:  # Else the last number that stands alone, without its commas.
            wanted = rng.choice(["7", "1,234", "-12.5", "12", "1,000,000"])
            text = f"{noise()} 3 {noise()} {wanted} {noise()}"
            wanted = wanted.replace(",", "")
        else:  # Else the first amount in dollars.
            wanted = rng.choice(["5", "2.50", ".5"])
            text = f"{noise()} ${wanted}! {noise()} $9x"
        rows.append((text, wanted))
    return rows


def test_number_answer_composed(spark):
    rows = composed_numbers(2, 3000)
    got = column(spark, [text for text, _ in rows], extract.number_answer)
    assert [(t, w, g) for (t, w), g in zip(rows, got) if g != w] == []


def test_number_answer_on_long_text(spark):
    texts = ["word " * 200_000 + "1,234 items", "= x " * 100_000, " " * 300_000 + "$ 5.", "answer is\n" * 100_000]
    texts += ["so, the result " * 50_000 + "is 3", "so, the result is 4" + " result 12x" * 50_000, "1" * 500_000 + "x"]
    assert column(spark, texts, extract.number_answer) == ["1234", "", "5", "", "3", "4", ""]


@pytest.mark.parametrize(
    "response, answer",
    [
        (r"\boxed{1} then \boxed{\frac{1}{2}}", r"\frac{1"),
        ("thus\nx = 3.", "x = 3"),
        ("The answer is: I am not sure", ""),
        ("", ""),
        ("  \n ", ""),
        (r"\boxed{\boxed{5}}", r"\boxed{5"),
        (r"\boxed{ $7$ }", "7"),
        ("\\boxed{1\n2}", "2}"),
        ("value\n . $\n", "value"),
    ],
)
def test_math_answer(spark, response, answer):
    expected = "" if response == "value\n . $\n" else answer
    assert column(spark, [response], extract.math_answer) == [expected]


def composed_math(seed, count):
    """Texts around a chosen box or last line: (text, what the rules have to find, null for nothing)."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        noise = lambda: "\n".join(rng.choice(["we look at it", "and so on.", "", " ", "é then", "a = b"]) for _ in range(rng.randrange(4)))
        inner = rng.choice(["7", "x+1", r"\frac{1", "a b", "12"])
        way = rng.randrange(4)
        if way == 0:  # The last box, up to its first closing brace.
            text = f"{noise()} \\boxed{{3}} {noise()} \\boxed{{ {inner}$ }} {noise()}\nlast 5"
            wanted = inner
        elif way == 1:  # Without a box, a last line with a digit or a sign.
            text, wanted = f"{noise()}\n . {inner} = 4 . \n \n", f"{inner} = 4"
        elif way == 2:  # Words alone, and long lines, are no answer.
            text = f"{noise()}\n" + rng.choice(["just words here", "1 " * 45])
            wanted = None
        else:  # A short line that is not words alone counts without digits.
            text, wanted = f"{noise()}\n  a, b. ", "a, b"
        rows.append((text, wanted))
    return rows


def test_math_answer_composed(spark):
    rows = composed_math(3, 3000)
    got = column(spark, [text for text, _ in rows], extract.math_answer_or_null)
    assert [(t, w, g) for (t, w), g in zip(rows, got) if g != w] == []


def test_keywords_before_the_last_line_change_nothing(spark):
    """A pattern that takes all text from a keyword to the end leaves none behind it, so no step can follow it."""
    texts = ["The answer is: 5\nx = 3", "answer: 4", "the final answer is: words alone"]
    assert column(spark, texts, extract.math_answer_or_null) == ["x = 3", "answer: 4", None]


def test_math_answer_on_long_text(spark):
    texts = ["\\boxed{" * 100_000, "word " * 200_000 + "\n7", "\\boxed{3}" + "\n\\boxed{" * 100_000, "(" * 500_000]
    assert column(spark, texts, extract.math_answer) == ["", "7", "3", ""]


def grade(spark, grader, rows):
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i INT, e STRING, t STRING").orderBy("i")
    return [row[0] for row in table.select(grader.grade(F.col("e"), F.col("t"))).collect()]


def test_exact_match(spark):
    table = spark.createDataFrame([("(b)", "(B)."), ("a b", "ab"), ("x", None)], "e STRING, t STRING")
    match = correct.exact_match(F.col("e"), correct.exact_key(F.col("t")))
    assert [row[0] for row in table.select(match).collect()] == [True, False, None]
    number = spark.range(1).select(correct.exact_match(F.lit("2"), correct.exact_key(F.lit(2))))
    assert number.first()[0] is True


def test_number_match(spark):
    rows = [
        ("48", "Sold 48/2 = 24. #### 72"),
        ("123", "1234"),
        ("", "5"),
        ("5", "none"),
        ("5", None),
        ("1234", "1,234"),
        ("0.1", ".1000000001"),
        ("5", "+-5"),
        ("\u0663", "3"),
        ("1e400", "5"),
    ]
    expected = [True, True, False, False, None, True, False, False, True, False]
    assert grade(spark, NUMBER, rows) == expected


def test_number_match_composed(spark):
    rng = random.Random(5)
    rows, expected = [], []
    for _ in range(1500):
        number = rng.choice([0, 5, 12, 999, -7, 0.5, 2.25])
        shift = rng.choice([0, 0, 1e-9, 0.01, -3])
        truth = f"{rng.choice(['it is ', '', '#### ', 'about '])}{number}{rng.choice(['', ' in all', ' or 77'])}"
        rows.append((str(number + shift), truth))
        expected.append(abs(shift) < 1e-6)
    assert grade(spark, NUMBER, rows) == expected


def test_final_number(spark):
    rows = [("72", "Sold 48/2 = 24. #### 72"), ("1234", "#### 1,234"), ("123", "1234")]
    assert grade(spark, FINAL_NUMBER, rows) == [True, True, False]


def test_math_match(spark):
    rows = [
        ("1 / 2", r"so \boxed{1/2}"),
        ("X=3.", "thus\nx = 3."),
        ("", r"\boxed{1}"),
        ("1", "this has no final answer at all"),
        ("1", None),
        ("$", r"\boxed{ $ }"),
    ]
    assert grade(spark, MATH, rows) == [True, True, False, False, None, True]


def test_names(spark):
    table = spark.createDataFrame([("org/Some-1.5B", "path/to/bbh_syn_all.json")], "m STRING, d STRING")
    assert table.select(text.model_label(F.col("m")), text.dataset_label(F.col("d"))).first() == ("Some-1.5B", "bbh_syn_all")
