"""weir: a Spark-first engine for a SQL-like stream query language."""

__version__ = "0.1.0"
