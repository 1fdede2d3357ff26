"""Subgroup-fairness analytics on Spark DataFrames."""
