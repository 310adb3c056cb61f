"""Option-list functions: arrays of answer options to prompt lines.

Letter lists are short and fixed, so those functions unroll into plain string
expressions, which stay inside generated code. Lists of any length use the
higher-order array functions.
"""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A null option prints as Python prints it, so that no option line is lost.
_NULL_TEXT = "None"


def _text(option: Column) -> Column:
    return F.coalesce(option.cast("string"), F.lit(_NULL_TEXT))


def shown(value: Column) -> Column:
    """A value as it prints in a prompt."""
    return _text(value)


def lettered(options: Column, letters: Sequence[str], strict: bool = False) -> Column:
    """``A. text`` lines by position.

    More options than letters give null, or an error with ``strict``.
    """
    lines = [
        F.when(F.size(options) > i, F.concat(F.lit(f"{letter}. "), _text(F.get(options, F.lit(i))), F.lit("\n")))
        for i, letter in enumerate(letters)
    ]
    too_many = F.raise_error(F.lit(f"more than {len(letters)} options")) if strict else F.lit(None)
    return F.when(F.size(options) > len(letters), too_many.cast("string")).when(
        options.isNotNull(), F.concat_ws("", *lines)
    )


def labelled_zip(labels: Column, texts: Column) -> Column:
    """``label. text`` lines from two lists, cut to the shorter list."""
    common = F.slice(labels, 1, F.least(F.size(labels), F.size(texts)))
    lines = F.transform(common, lambda label, i: F.concat(_text(label), F.lit(". "), _text(F.get(texts, i)), F.lit("\n")))
    return F.array_join(lines, "")


def labelled_lookup(labels: Column, texts: Column, strict: bool = False) -> Column:
    """``label. text`` lines for every label; fewer texts give null, or an error with ``strict``."""
    lines = F.transform(labels, lambda label, i: F.concat(_text(label), F.lit(". "), _text(F.get(texts, i)), F.lit("\n")))
    too_few = F.raise_error(F.lit("fewer option texts than labels")) if strict else F.lit(None)
    return F.when(F.size(texts) < F.size(labels), too_few.cast("string")).otherwise(F.array_join(lines, ""))


def numbered(options: Column, parentheses: bool = False) -> Column:
    """``0.text`` lines, or ``(0).text`` with ``parentheses``."""
    before, after = ("(", ").") if parentheses else ("", ".")
    lines = F.transform(
        options, lambda text, i: F.concat(F.lit(before), i.cast("string"), F.lit(after), _text(text), F.lit("\n"))
    )
    return F.array_join(lines, "")


def parse_list(literal: Column) -> Column:
    """A list of strings written as a Python literal; never evaluated as code."""
    return F.from_json(literal, "array<string>", {"allowBackslashEscapingAnyCharacter": "true"})


def relabel_packed(options: Column, letters: str = "abcde") -> Column:
    """``a ) 24 , b ) 120`` to ``A.  24 , B.  120`` by plain replacement."""
    for letter in letters:
        options = F.replace(options, F.lit(f"{letter} )"), F.lit(f"{letter.upper()}. "))
    return options


def shuffled(options: Sequence[Column], example_id: Column, seed: int = 42) -> Column:
    """The options in an order that depends only on seed and row id.

    Each option sorts by a hash of seed, id and position, so the order survives
    any partitioning, retry or row order.
    """
    keyed = F.array(
        *[
            F.struct(
                F.md5(F.concat_ws("|", F.lit(str(seed)), example_id.cast("string"), F.lit(str(i)))).alias("order"),
                option.alias("text"),
            )
            for i, option in enumerate(options)
        ]
    )
    return F.sort_array(keyed).getField("text")


def position_label(options: Column, correct: Column) -> Column:
    """``(pos)`` of the first option equal to ``correct``, from 0; null when it is not there."""
    position = F.array_position(options, correct)
    return F.when(position > 0, F.concat(F.lit("("), (position - 1).cast("string"), F.lit(")")))
