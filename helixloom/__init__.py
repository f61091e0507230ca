"""Spark-first assembly and audit of sequence constructs."""
