"""Question-driven memory over time-ordered streams, as DataFrame, SQL and Structured Streaming operators."""
