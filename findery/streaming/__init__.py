"""Structured Streaming: ingestion and the state of jobs."""
