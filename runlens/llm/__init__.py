"""Operators for text corpora, each written as Spark jobs."""
