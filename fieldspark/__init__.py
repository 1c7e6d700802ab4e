"""Spark-first array, spatial and stateful-stream analytics."""
