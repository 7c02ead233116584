"""The per-step work as Structured Streaming jobs."""
