"""Corpus analysis on Spark DataFrames."""
