"""Answer extraction: response text to answer string.

All of it is built-in string functions, so that it stays inside generated code.
Where a rule tries several patterns in turn, one anchored regular expression
holds them as alternatives, so that no expression runs twice. Rules of two steps are split in a step that passes over the
text and one that looks at its short outcome; scoring puts them in columns of
their own, so that the first is worked out once.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright import fixed
from scorewright.functions.text import strip_chars, strip_space


def after_marker(response: Column) -> Column:
    """Lower-case text after the last answer marker, or all of it, without outer dots and spaces."""
    answer = F.lower(response)
    for marker in fixed.ANSWER_MARKERS:
        answer = F.substring_index(answer, marker, -1)
    return strip_chars(answer, fixed.ANSWER_STRIP)


def or_letter(response: Column, answer: Column, letters: Sequence[str]) -> Column:
    """The answer, or, when that is over five characters, a letter in its place.

    The letter is the first one, in list order, found anywhere in the response.
    """
    chosen = F.when(F.length(answer) <= 5, answer)
    for letter in letters:
        chosen = chosen.when(F.contains(response, F.lit(letter)), F.lit(letter))
    return chosen.otherwise(answer)


def letter_or_marker(response: Column, letters: Sequence[str]) -> Column:
    """Text after the last answer marker, or a choice letter when that is long."""
    return or_letter(response, after_marker(response), letters)


def _any_case(word: str) -> str:
    """Pattern of a word in any case; letter classes search far faster than Java's own flag."""
    return "".join(f"[{letter.upper()}{letter}{fixed.CASE_PARTNERS.get(letter, '')}]" for letter in word)


_STATED = rf"{fixed.SPACE}+(?:{_any_case('is')}|=){fixed.SPACE}*({fixed.FLOAT_NUMBER})"


def stated_answer(response: Column) -> Column:
    """The number of the first "answer is N"; empty when there is none."""
    return F.regexp_extract(response, _any_case("answer") + _STATED, 1)


def _first_match(text: Column, *patterns: str) -> Column:
    """The group of the first pattern, in the order given, that the text holds; empty when it holds none."""
    # Groups of the alternatives that were not taken are empty in the replacement.
    groups = "".join(f"${i + 1}" for i in range(len(patterns)))
    return F.regexp_replace(text, rf"(?s)\A(?:{'|'.join(patterns)}|).*\z", groups)


# A "final answer" or "so, the answer" holds a plain "answer is N", so only "result" needs a lead.
_RESULTS = (
    rf".*?{_any_case('final')}{fixed.SPACE}+{_any_case('result')}{_STATED}",
    rf".*?(?:{'|'.join(map(_any_case, ('therefore', 'thus', 'so', 'hence')))}),{fixed.SPACE}+"
    rf"(?:{_any_case('the')}{fixed.SPACE}+)?{_any_case('result')}{_STATED}",
)
# The last number after an equals sign.
_EQUAL = rf".*={fixed.SPACE}*({fixed.FLOAT_NUMBER})"
# The last number that stands alone between white space or the ends of the text. A digit or sign
# is rarer than white space, so that is looked for first.
_ALONE = (
    rf"(?:.*(?=[-+0-9[\x{{100}}-\x{{10ffff}}&&\p{{Nd}}]])(?<={fixed.SPACE}))?"
    rf"({fixed.GROUPED_NUMBER})(?={fixed.SPACE}|\z)"
)
# The first dollar amount.
_DOLLAR = rf".*?\${fixed.SPACE}*({fixed.DOLLAR_NUMBER})"


def or_last_number(response: Column, stated: Column) -> Column:
    """The stated answer, else the number that a solution ends in; empty when there is none.

    Each branch holds only the patterns that can match in its texts, as every one is a pass.
    """
    number = (
        F.when(stated != "", stated)
        .when(response.rlike(_any_case("result")), _first_match(response, *_RESULTS, _EQUAL, _ALONE, _DOLLAR))
        .when(response.rlike("[=$]"), _first_match(response, _EQUAL, _ALONE, _DOLLAR))
        .otherwise(F.regexp_extract(response, rf"(?s)\A{_ALONE}", 1))
    )
    return F.replace(number, F.lit(","), F.lit(""))


def number_answer(response: Column) -> Column:
    """The number a worked solution ends in, as text; empty when there is none."""
    return or_last_number(response, stated_answer(response))


# In front of a last line that has still to be judged; no boxed answer starts with it.
_UNJUDGED = "\n"


def first_brace_box(text: Column) -> Column:
    """The last box of a line that closes, up to the first closing brace after one character; null without one."""
    # (?d): only a line feed ends a line. An open box takes the rest of its line, where no other
    # could close, and leaves an empty group.
    boxes = F.regexp_extract_all(text, F.lit(r"(?d)\\boxed\{(?:(.+?)\}|.*+)"), F.lit(1))
    return F.try_element_at(F.array_remove(boxes, F.lit("")), F.lit(-1))


def balanced_box(text: Column) -> Column:
    """What is in the last box, up to the brace that closes it, over any lines; null if it is empty or never closes.

    One pass over the pieces between closing braces counts how many braces are open after each.
    """
    box = "\\boxed{"
    pieces = F.split(F.substring_index(text, box, -1), r"\}")

    def step(at: Column, piece: Column) -> Column:
        opened = F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        still = at["open"] + opened - 1
        return F.when(at["open"] == 0, at).otherwise(F.struct(still.alias("open"), (at["pieces"] + 1).alias("pieces")))

    # Behind the last piece no brace closes.
    closed = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    end = F.aggregate(closed, F.struct(F.lit(1).alias("open"), F.lit(0).alias("pieces")), step)
    inside = F.when(end["open"] == 0, F.array_join(F.slice(pieces, F.lit(1), end["pieces"]), "}"))
    return F.when(F.contains(text, F.lit(box)) & (inside != ""), inside)


def boxed_or_line(text: Column, box: Callable[[Column], Column] = first_brace_box) -> Column:
    """The last boxed expression, else a line feed and the last line that is not blank."""
    boxed = box(text)
    body = F.rtrim(strip_space(text), F.lit(fixed.MATH_LINE_STRIP + "\n"))
    line = strip_chars(F.substring_index(body, "\n", -1), fixed.MATH_LINE_STRIP)
    return F.coalesce(strip_chars(boxed, fixed.MATH_ANSWER_STRIP), F.concat(F.lit(_UNJUDGED), line))


def judged_line(found: Column) -> Column:
    """What :func:`boxed_or_line` found; null for a line that does not look like an answer."""
    # The lengths count the line feed.
    is_answer = (
        F.length(found).between(2, 80)
        & ~found.rlike(rf"\A[a-zA-Z{fixed.SPACE_CHARACTERS}]+\z")
        & ((F.length(found) <= 10) | found.rlike(r"[\p{Nd}=$()^]"))
    )
    line = F.when(is_answer, F.substr(found, F.lit(2)))
    return F.when(F.startswith(found, F.lit(_UNJUDGED)), line).otherwise(found)


def math_answer_or_null(text: Column) -> Column:
    """The last boxed expression, else a last line that looks like an answer, else null."""
    return judged_line(boxed_or_line(text))


def or_empty(response: Column, answer: Column) -> Column:
    """Empty text for a response without an answer; null only without a response."""
    return F.when(response.isNotNull(), F.coalesce(answer, F.lit("")))


def math_answer(response: Column) -> Column:
    """As :func:`math_answer_or_null`, with empty text for a response that has no answer."""
    return or_empty(response, math_answer_or_null(response))
