"""captureq: web-capture analytics on Spark DataFrames."""
