"""Structured Streaming operators: idempotent enqueue, per-project job lanes, event log, windows over events."""
