"""Corpus, search, quality, statistics and catalogue operators on DataFrames."""
