"""Log-anomaly analytics as Spark DataFrame operators (batch and Structured Streaming)."""
