"""Localization-quality analytics on Spark DataFrames."""
