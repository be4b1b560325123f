"""Operators: each takes DataFrames and returns a DataFrame (or a fitted
Spark ML model plus DataFrames)."""
