"""Analytics over governed lakehouse data, declared as Spark DataFrames."""

__version__ = "0.1.0"
