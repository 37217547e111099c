"""Everyday table work as distributed Spark jobs: DataFrames in, DataFrames out."""
