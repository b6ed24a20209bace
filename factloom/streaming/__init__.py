"""Structured Streaming: ingest of changed files, work barriers and tumbling budgets."""
