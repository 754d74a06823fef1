"""The operators: DataFrames and plain arguments in, DataFrames out."""
