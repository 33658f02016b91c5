"""Structured Streaming forms of the quality and anomaly operators."""
