"""derlem: a Spark-native engine for searching, cleaning and analysing large text corpora."""

__version__ = "0.1.0"
