"""Corpus-scale text de-identification and leak measurement on Spark DataFrames."""
