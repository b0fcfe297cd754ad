"""Operators on the memory and on corpora, from DataFrames to DataFrames."""
