"""Probabilistic catalogue analytics on Spark DataFrames."""
