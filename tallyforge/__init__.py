"""Tallyforge: a Spark-first engine for source-change review analytics."""
