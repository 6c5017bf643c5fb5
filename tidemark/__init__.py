"""Incremental materialized views on PySpark."""
