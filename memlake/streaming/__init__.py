"""Structured Streaming folds of the event log."""
