"""First-token log-probabilities of the answer choices."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright import fixed
from scorewright.schemas import CANDIDATES


def _array(values: Sequence) -> Column:
    return F.array(*[F.lit(str(value)) for value in values])


def choices_for(truth: Column) -> Column:
    """The family of choices a truth belongs to; a truth of no family stands alone."""
    truth = truth.cast("string")
    first, *others = fixed.CHOICE_FAMILIES
    family = F.when(truth.isin(*first), _array(first))
    for choices in others:
        family = family.when(truth.isin(*choices), _array(choices))
    return family.otherwise(F.array(truth))


def fixed_choices(choices: Sequence) -> Column:
    """A benchmark's own choices, as text, since tokens are text."""
    return _array(choices)


def top_candidates(candidates: Column, k: int | None = fixed.TOP_LOGPROBS) -> Column:
    """The ``k`` likeliest candidates, equal ones by token; all of them in that order when ``k`` is None."""
    by_logprob = F.transform(candidates, lambda c: F.struct(c["logprob"].alias("logprob"), c["token"].alias("token")))
    best = F.sort_array(by_logprob, asc=False)
    if k is not None:
        best = F.slice(best, 1, k)
    return F.transform(best, lambda c: F.struct(c["token"].alias("token"), c["logprob"].alias("logprob"))).cast(CANDIDATES)


def among(candidates: Column, choices: Column) -> Column:
    """Candidates whose token is a choice."""
    return F.filter(candidates, lambda candidate: F.array_contains(choices, candidate["token"]))


def last_of_token(candidates: Column) -> Column:
    """Of candidates with the same token the last one."""
    backwards = F.reverse(candidates["token"])
    return F.filter(candidates, lambda c, i: F.array_position(backwards, c["token"]) == F.size(candidates) - i)


def as_map(candidates: Column) -> Column:
    """Token to log-probability of candidates without repeated tokens; empty for none."""
    return F.coalesce(F.map_from_entries(candidates), F.create_map().cast("map<string,double>"))


def choice_logprobs(candidates: Column, choices: Column) -> Column:
    """Token to log-probability for candidates among the choices.

    The last of several candidates with the same token counts; no candidates
    give an empty map.
    """
    return as_map(last_of_token(among(candidates, choices)))
