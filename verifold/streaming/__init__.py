"""Structured Streaming forms of the batch operators."""

from .streams import bank_stream, fresh_outputs, pooled_counts, run_budget, session_activity, windowed_counts  # noqa: F401
