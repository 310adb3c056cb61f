"""Adapters: what one benchmark's rows mean.

An adapter projects a benchmark table to items (prompt and ground truth) and
names the grader of its responses. Users extend the library by making their own
``Adapter``; every hook takes and returns Columns (or, for ``prepare``, a
DataFrame), and a ``pandas_udf`` is a Column function too.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorewright import fixed
from scorewright.functions.prompts import keyed_prompt, with_instruction
from scorewright.operators.grader import EXACT, Grader


@dataclass(frozen=True)
class Adapter:
    """One benchmark.

    :param name: registry name; also the ``dataset`` of its items
    :param columns: input schema as DDL
    :param prompt: prompt column over the (prepared) input
    :param truth: ground-truth column over the (prepared) input
    :param split: split that is read by default
    :param subset: subset that is read by default; all of them when None
    :param grader: extraction and comparison
    :param choices: answer choices for log-probabilities; from the truth when None
    :param instruction: text put before the prompt; None when the prompt is final
    :param prepare: reshapes the input first
    :param optional: columns that a table of this benchmark may lack
    :param mapped_truth: whether the truth is looked up, so that none found is an error of the table
    """

    name: str
    columns: str
    prompt: Callable[[], Column]
    truth: Callable[[], Column]
    split: str = "test"
    subset: str | None = None
    grader: Grader = EXACT
    choices: tuple[str, ...] | None = None
    instruction: str | None = fixed.INSTRUCTION
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda table: table)
    optional: tuple[str, ...] = ()
    mapped_truth: bool = False

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)

    def full_prompt(self) -> Column:
        """The prompt as the model gets it."""
        prompt = self.prompt()
        return prompt if self.instruction is None else with_instruction(prompt, self.instruction)


def keyed_adapter(name: str, input_keys: Sequence[str], output_key: str, **options) -> Adapter:
    """Adapter for any table whose prompt is its input columns and whose truth is a column."""
    columns = ", ".join(f"`{key}` STRING" for key in dict.fromkeys([*input_keys, output_key]))
    return Adapter(name, columns, lambda: keyed_prompt(input_keys), lambda: F.col(f"`{output_key}`"), **options)


def pick_by_dataset(
    adapters: Sequence[Adapter],
    value: Callable[[Adapter], object],
    column: Callable[[object], Column],
    otherwise: Column | None = None,
) -> Column:
    """A column that follows each row's ``dataset``.

    Datasets that share a value share one branch, so many benchmarks are handled
    in one pass over the table. A dataset that an adapter names comes first; the
    registered synthetic adapter stands for the other synthetic datasets. A dataset
    without an adapter is an error, unless ``otherwise`` gives it a value.
    """
    branches: dict = {}
    for adapter in adapters:
        branches.setdefault(value(adapter), []).append(adapter.name)
    dataset = F.col("dataset")
    if otherwise is None:
        name = F.coalesce(dataset, F.lit("null"))
        otherwise = F.raise_error(F.concat(F.lit("Dataset "), name, F.lit(" not supported")))
    named = {name for names in branches.values() for name in names}
    chosen = None
    for shared, names in branches.items():
        of_branch = dataset.isin(*names)
        if fixed.SYNTHETIC_SUFFIX in names:
            others = sorted(name for name in named - set(names) if name.endswith(fixed.SYNTHETIC_SUFFIX))
            unnamed = F.endswith(dataset, F.lit(fixed.SYNTHETIC_SUFFIX))
            of_branch = of_branch | (unnamed & ~dataset.isin(*others) if others else unnamed)
        chosen = F.when(of_branch, column(shared)) if chosen is None else chosen.when(of_branch, column(shared))
    return otherwise if chosen is None else chosen.otherwise(otherwise)
