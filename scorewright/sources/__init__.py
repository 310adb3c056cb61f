"""Reading benchmark tables, responses and metrics; writing results, metrics and reports."""
