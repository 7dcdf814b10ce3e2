"""Structured Streaming jobs over logs, the retry queue and new samples."""
