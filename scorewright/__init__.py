"""Scoring of language-model answers on question-answering benchmarks, on Spark."""

from scorewright.operators.adapter import Adapter, keyed_adapter
from scorewright.operators.benchmarks import REGISTRY, get_adapter
from scorewright.operators.generate import generate
from scorewright.operators.grader import Grader, letter_grader
from scorewright.operators.items import build_items, with_content_id
from scorewright.operators.metrics import accuracy_matrix, run_metrics, wide_metrics
from scorewright.operators.score import assemble, grade, score
from scorewright.plans.aggregate import aggregate_runs
from scorewright.plans.evaluate import evaluate, respond

__all__ = [
    "Adapter",
    "Grader",
    "REGISTRY",
    "accuracy_matrix",
    "aggregate_runs",
    "assemble",
    "build_items",
    "evaluate",
    "generate",
    "get_adapter",
    "grade",
    "keyed_adapter",
    "letter_grader",
    "respond",
    "run_metrics",
    "score",
    "wide_metrics",
    "with_content_id",
]
