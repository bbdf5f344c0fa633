"""Lexicon retrieval and evaluation on Spark DataFrames."""
