"""Spark DataFrame and Structured Streaming operators over GPU-training-job data."""
