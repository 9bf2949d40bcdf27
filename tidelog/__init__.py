"""Object-centric event analytics on Spark: logs, property time series and analyses as DataFrames."""
