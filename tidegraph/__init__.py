"""Spark-first analytics over property graphs, documents and import pipelines."""

__version__ = "0.1.0"
