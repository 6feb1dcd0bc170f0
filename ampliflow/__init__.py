"""Read demultiplexing and analysis on Spark DataFrames."""
