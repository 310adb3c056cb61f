"""Queries over the test tables: each shows an operator at work and has its meaning in SQL beside it."""

from catalog import extraction, inputs, logprobs, options, prompts, runs, scoring, storage

MODULES = (scoring, extraction, options, prompts, logprobs, runs, storage)


def all_queries() -> dict[str, inputs.Query]:
    found: dict[str, inputs.Query] = {}
    for module in MODULES:
        for query in module.QUERIES:
            if query.name in found:
                raise ValueError(f"two queries named {query.name}")
            found[query.name] = query
    return found
