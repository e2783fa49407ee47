"""barloom: candlestick time series on Spark DataFrames, and operators for large text corpora."""
