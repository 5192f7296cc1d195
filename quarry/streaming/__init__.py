"""The same SELECT dialect over Structured Streaming sources."""
