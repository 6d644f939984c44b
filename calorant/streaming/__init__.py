"""Structured Streaming: append with restart, watermarks, windows."""
