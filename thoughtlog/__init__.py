"""Distributed analysis of diary-like text collections with PySpark DataFrames."""
