"""Structured Streaming variants of the telemetry summaries (an extension)."""
