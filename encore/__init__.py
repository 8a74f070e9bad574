"""Repeat-purchase analytics as PySpark operators: DataFrames in, DataFrames out."""
