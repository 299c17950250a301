"""Fault localisation and log analytics on Spark DataFrames."""
