"""Structured Streaming: what a batch build does to a folder, done to files as they arrive (an extension)."""
