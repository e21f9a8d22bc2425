"""Last-mile delivery analytics as DataFrame, SQL and Structured Streaming jobs."""
