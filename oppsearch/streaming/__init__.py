"""Structured Streaming: incremental indexing and per-thread turn state."""
