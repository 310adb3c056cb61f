"""Whole jobs: evaluate one or many runs, aggregate runs to reports."""
