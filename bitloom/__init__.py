"""Structural analytics of byte data on Spark DataFrames."""
