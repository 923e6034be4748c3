"""Spark-first analytics for text-retrieval corpora."""
