"""The batch operators under Structured Streaming."""
