"""Activity-text analytics on Spark: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
