"""Ground-truth functions: a benchmark's label column to the answer string."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright import fixed


def _or_error(value: Column, index: Column, strict: bool) -> Column:
    if not strict:
        return value
    return F.coalesce(value, F.raise_error(F.concat(F.lit("no answer for label "), index.cast("string"))).cast("string"))


def letter_by_list(index: Column, letters: Sequence[str], strict: bool = False) -> Column:
    """Letter at a list index; a negative index counts from the end."""
    options = F.array(*map(F.lit, letters))
    position = F.when(index < 0, index + len(letters)).otherwise(index).cast("int")
    return _or_error(F.get(options, position), index, strict)


def letter_by_map(label: Column, keys: Sequence, letters: Sequence[str], strict: bool = False) -> Column:
    """Letter for a label; a label outside the map gives null, or an error with ``strict``."""
    chosen = F.lit(None).cast("string")
    for key, letter in reversed(list(zip(keys, letters))):
        chosen = F.when(label == F.lit(key), F.lit(letter)).otherwise(chosen)
    return _or_error(chosen, label, strict)


def checked_letter(label: Column, letters: Sequence[str]) -> Column:
    """Letter for a label written as text, with an error label where there is none."""
    # Wider than any label of text is likely to be, so that a large one is out of bounds and not invalid.
    whole = label.cast("string").try_cast("decimal(38,0)")
    index = F.when(label.cast("string").rlike(r"^\s*[-+]?[0-9]+\s*$"), whole)
    place = F.when(index.between(0, len(letters) - 1), index.cast("int"))
    return (
        F.when(index.isNull(), F.lit(fixed.LABEL_INVALID))
        .when(place.isNotNull(), F.get(F.array(*map(F.lit, letters)), place))
        .otherwise(F.lit(fixed.LABEL_OUT_OF_BOUNDS))
    )


def capitalized(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def first_span(spans: Column, strict: bool = False) -> Column:
    """First answer span."""
    return _or_error(F.get(spans, F.lit(0)), F.size(spans), strict)
