"""Customer segmentation and profiling on Spark DataFrames."""
