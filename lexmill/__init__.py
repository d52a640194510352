"""lexmill: a searchable corpus of text and code as Spark DataFrames."""

__version__ = "0.1.0"
