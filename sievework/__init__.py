"""sievework: a Spark-first engine for messy research data."""

__version__ = "0.1.0"
