"""Probabilistic analytics over many time series, built on Spark DataFrames."""
