"""Curation and evaluation operators on DataFrames."""
