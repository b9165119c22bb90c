"""Spark-first engine for marker matrices, call resolution and label hierarchies."""
