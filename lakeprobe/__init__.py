"""lakeprobe: dataset profiling and readiness checks on Spark DataFrames."""

__version__ = "0.1.0"
