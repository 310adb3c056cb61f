"""Scoring responses as they arrive."""
