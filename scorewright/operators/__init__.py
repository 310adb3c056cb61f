"""DataFrame-level operators: adapters, items, generation, scoring, run metrics."""
