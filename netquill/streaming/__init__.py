"""Structured Streaming: live logs to alerts."""
