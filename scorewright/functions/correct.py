"""Correctness: an extracted answer against a truth key.

Each rule comes in two parts. ``*_key`` reduces a ground truth to what the
comparison needs, once per item and before any join; ``*_match`` compares.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright import fixed
from scorewright.functions.extract import boxed_or_line, judged_line
from scorewright.functions.text import drop_space, plain_digits, strip_chars, to_double


def exact_key(truth: Column) -> Column:
    return strip_chars(F.lower(truth.cast("string")), fixed.EXACT_STRIP)


def exact_match(extracted: Column, key: Column) -> Column:
    """Equal text, whatever the case and the dots and spaces at the ends."""
    return exact_key(extracted) == key


def first_number_key(truth: Column) -> Column:
    """The first number in the truth text; empty when it has none."""
    number = F.regexp_extract(truth, rf"({fixed.GROUPED_NUMBER})", 1)
    return plain_digits(F.replace(number, F.lit(","), F.lit("")))


def final_number_key(truth: Column) -> Column:
    """The whole number after the last ``####``, or the first whole number without that mark."""
    digits = r"([-+]?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?)"
    number = F.regexp_extract(F.substring_index(truth, "####", -1), digits, 1)
    return plain_digits(F.replace(number, F.lit(","), F.lit("")))


def number_match(extracted: Column, key: Column) -> Column:
    """Numbers closer than the tolerance; anything that is not a number is wrong."""
    close = F.abs(to_double(plain_digits(extracted)) - key.try_cast("double")) < fixed.NUMERIC_TOLERANCE
    return F.coalesce(close, F.lit(False))


def _math_text(answer: Column) -> Column:
    return strip_chars(drop_space(F.lower(answer)), fixed.MATH_COMPARE_STRIP)


def judged_math_key(found: Column) -> Column:
    """What was found in the truth, ready to compare; null when it is no answer."""
    return _math_text(judged_line(found))


def math_key(truth: Column) -> Column:
    """The truth's own final answer, ready to compare; null when it has none."""
    return judged_math_key(boxed_or_line(truth))


def math_match(extracted: Column, key: Column) -> Column:
    """Equal text without white space; an empty answer or a missing key is wrong."""
    return F.coalesce((extracted != "") & (_math_text(extracted) == key), F.lit(False))
