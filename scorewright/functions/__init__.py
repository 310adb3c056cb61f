"""Column-level functions: options, truths, extraction, correctness, log-probabilities."""
