"""Analytics over task-queue operational data on Spark DataFrames."""

__version__ = "0.1.0"
