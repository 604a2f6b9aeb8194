"""tickframe: technical analysis of OHLCV bars on Spark DataFrames."""

__version__ = "0.1.0"
