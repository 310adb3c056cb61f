"""Graders: how responses of a benchmark are read and compared.

``extract`` sees only the response and ``key`` only the truth, so both run before
the two tables are joined and the join moves short answers instead of whole texts.

Either may have a second step for rules that look several times at what the
first step found. Scoring gives each step its own column: Spark then works the
first step out once, where nested in the second it would run at every mention.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright.functions import correct, extract


@dataclass(frozen=True)
class Grader:
    """How to grade a response.

    :param extract: response to answer
    :param settle: response and what ``extract`` found to answer, as a second step
    :param key: truth to the form that answers are compared with
    :param settle_key: what ``key`` found to that form, as a second step
    :param match: answer and truth key to correctness
    """

    extract: Callable[[Column], Column] = extract.after_marker
    key: Callable[[Column], Column] = correct.exact_key
    match: Callable[[Column, Column], Column] = correct.exact_match
    settle: Callable[[Column, Column], Column] | None = None
    settle_key: Callable[[Column], Column] | None = None

    def answer(self, response: Column) -> Column:
        """The answer in a response, as one expression."""
        found = self.extract(response)
        return found if self.settle is None else self.settle(response, found)

    def grade(self, extracted: Column, truth: Column) -> Column:
        """Correctness straight from a truth column; null without a truth or an answer."""
        found = self.key(truth)
        key = found if self.settle_key is None else self.settle_key(found)
        return F.when(truth.isNotNull() & extracted.isNotNull(), self.match(extracted, key))


@lru_cache(maxsize=None)
def letter_grader(letters: tuple[str, ...]) -> Grader:
    """Marker extraction that falls back to a choice letter."""
    return Grader(settle=partial(extract.or_letter, letters=letters))


def _math_answer(response: Column, found: Column) -> Column:
    return extract.or_empty(response, extract.judged_line(found))


EXACT = Grader()
NUMBER = Grader(
    extract.stated_answer, correct.first_number_key, correct.number_match, extract.or_last_number
)
FINAL_NUMBER = Grader(
    extract.stated_answer, correct.final_number_key, correct.number_match, extract.or_last_number
)
MATH = Grader(
    extract.boxed_or_line, extract.boxed_or_line, correct.math_match, _math_answer, correct.judged_math_key
)
# As MATH, but a box closes at the brace that balances its first one.
_BALANCED = partial(extract.boxed_or_line, box=extract.balanced_box)
MATH_BALANCED = Grader(_BALANCED, _BALANCED, correct.math_match, _math_answer, correct.judged_math_key)
