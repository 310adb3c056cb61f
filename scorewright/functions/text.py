"""String helpers that follow Python's rules where those differ from Java's."""

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's str.strip() removes.
PYTHON_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip_space(text: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.btrim(text, F.lit(PYTHON_SPACE))


def drop_space(text: Column) -> Column:
    """Remove all Unicode white space."""
    return F.translate(text, PYTHON_SPACE, "")


def strip_chars(text: Column, chars: str) -> Column:
    """Trim any of ``chars`` from both ends."""
    return F.btrim(text, F.lit(chars))


@lru_cache(maxsize=1)
def _decimal_digits() -> tuple[str, str]:
    digits = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) is not None]
    return "".join(digits), "".join(str(unicodedata.decimal(d)) for d in digits)


def plain_digits(text: Column) -> Column:
    """Decimal digits of any script as ASCII digits."""
    return F.translate(text, *_decimal_digits())


def to_double(text: Column) -> Column:
    """The number a decimal string stands for; null if it is none."""
    # Java also parses type suffixes ("1d") and hexadecimal floats; those are not numbers here.
    is_number = ~text.rlike("[dDfFxX]")
    return F.when(is_number, text.try_cast("double"))


def last_path_part(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def model_label(model: Column) -> Column:
    """Short model name used for output: the last part of its path."""
    return last_path_part(model)


def dataset_label(dataset: Column) -> Column:
    """Short dataset name used for output: the last path part up to its first dot."""
    return F.substring_index(last_path_part(dataset), ".", 1)
