"""Structured Streaming forms of the time-bucketed aggregates, and versioned tables as sinks."""
