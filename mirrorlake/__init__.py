"""Duplicate analytics on Spark: a corpus as DataFrames, answers as plans."""
