"""Timeline, interval, signal and transcript analytics on Spark DataFrames."""
