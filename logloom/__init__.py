"""logloom: recorded-log analytics on Spark.

Scans robotics log containers as DataFrames, reshapes nested records, and
carries the data-quality operators that a training-data pipeline needs.
"""

__version__ = "0.1.0"
