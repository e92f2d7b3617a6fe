"""quarrylight: evidence analytics on PySpark DataFrames, SQL and Structured Streaming."""

__version__ = "0.1.0"
