"""The event pipeline on Structured Streaming."""
