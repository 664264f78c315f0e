"""Structured Streaming jobs: the task queue."""
