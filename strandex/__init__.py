"""Spark-first indexing and retrieval of sequence records, and corpus operators."""
