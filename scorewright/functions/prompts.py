"""Prompt building blocks shared by the benchmark adapters."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright import fixed


def keyed_prompt(input_keys: Sequence[str]) -> Column:
    """The input columns one after the other, with the options line after the first of several."""
    parts = []
    for i, key in enumerate(input_keys):
        parts.append(F.col(f"`{key}`").cast("string"))
        if i < len(input_keys) - 1:
            parts.append(F.lit("\n"))
        if i == 0 and len(input_keys) > 1:
            parts.append(F.lit(fixed.KEYED_OPTIONS_LINE))
    return F.concat(*parts)


def or_placeholder(text: Column, placeholder: str) -> Column:
    """The text, or the placeholder when it is null or empty."""
    return F.when(F.length(text) > 0, text).otherwise(F.lit(placeholder))


def with_instruction(prompt: Column, instruction: str = fixed.INSTRUCTION) -> Column:
    """The instruction in front of the prompt."""
    return F.concat(F.lit(instruction + "\n "), prompt)


def is_chat_model(model: Column) -> Column:
    """Whether a model's name says that it takes chat messages."""
    name = F.lower(model)
    first, *others = fixed.CHAT_MODEL_WORDS
    found = F.contains(name, F.lit(first))
    for word in others:
        found = found | F.contains(name, F.lit(word))
    return found


def chat_messages(prompt: Column, system: str = fixed.SYSTEM_PROMPT) -> Column:
    """System and user message for a chat model."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", prompt))
