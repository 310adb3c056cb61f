"""Batch inference hook: prompts to responses with a model the user supplies."""

import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from scorewright.schemas import ANSWER, ANSWER_COLUMNS

# A model takes the prompts of one batch and gives, in the same order, either
# texts or (text, [(token, logprob), ...]) pairs.
Model = Callable[[list[str]], Sequence]

# Models of this Python worker, by the call of ``generate`` that they belong to.
_MODELS: dict[str, Model] = {}

_CANDIDATES_TYPE = pa.list_(pa.struct([("token", pa.string()), ("logprob", pa.float64())]))
_TIME_TYPE = pa.timestamp("us", tz="UTC")


def _answered(batch: pa.RecordBatch, prompt: str, model: Model) -> pa.RecordBatch:
    started = datetime.now(timezone.utc)
    outputs = list(model(batch.column(prompt).to_pylist()))
    finished = datetime.now(timezone.utc)
    if len(outputs) != batch.num_rows:
        raise ValueError(f"the model gave {len(outputs)} responses to {batch.num_rows} prompts")
    pairs = [(output, None) if isinstance(output, str) else output for output in outputs]
    candidates = [
        None if found is None else [{"token": token, "logprob": logprob} for token, logprob in found]
        for _, found in pairs
    ]
    columns = {name: batch.column(name) for name in batch.schema.names}
    columns["response"] = pa.array([text for text, _ in pairs], pa.string())
    columns["first_token_logprobs"] = pa.array(candidates, _CANDIDATES_TYPE)
    columns["started_at"] = pa.array([started] * batch.num_rows, _TIME_TYPE)
    columns["finished_at"] = pa.array([finished] * batch.num_rows, _TIME_TYPE)
    return pa.RecordBatch.from_pydict(columns)


def _model(call: str, load_model: Callable[[], Model]) -> Model:
    if call not in _MODELS:
        _MODELS.clear()  # Those of earlier calls only take memory.
        _MODELS[call] = load_model()
    return _MODELS[call]


def generate(prompts: DataFrame, load_model: Callable[[], Model], batch_size: int = 8, prompt: str = "prompt") -> DataFrame:
    """Answer every prompt with a user's model.

    ``load_model`` runs once in each Python worker, which Spark uses for many tasks; the model then gets ``batch_size``
    prompts at a time, the last batch of an Arrow batch being shorter. Nothing is
    collected: rows stream through the Python workers in their partitions.

    :return: the input columns with ``response``, ``first_token_logprobs`` and the
        times at which the row's batch started and finished
    """

    call = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, batch_size):
                yield _answered(rows.slice(start, batch_size), prompt, _model(call, load_model))

    kept = prompts.drop(*ANSWER_COLUMNS)
    return kept.mapInArrow(run, StructType(kept.schema.fields + StructType.fromDDL(ANSWER).fields))
