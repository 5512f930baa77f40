"""Corpus curation, retrieval and dataset building on PySpark DataFrames."""
