"""lexmill: a Spark-first engine for legal text corpora and their operational data."""

__version__ = "0.1.0"
