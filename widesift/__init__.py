"""Feature selection and classifier benchmarking for very wide labelled tables, on Spark DataFrames."""
