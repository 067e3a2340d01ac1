"""Leakage-safe evaluation of tabular classifiers as Spark jobs."""
