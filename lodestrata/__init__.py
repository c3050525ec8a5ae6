"""Density-based subspace clustering on Spark DataFrames."""
