"""Change logs and change feeds on Structured Streaming."""
