"""Operators for training-data pipelines, built on Spark; nothing else in the library imports this package."""
