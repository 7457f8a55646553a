"""Network analytics on Spark: edge, node, partition and series DataFrames in, DataFrames out."""
