"""Curation and evaluation of annotated datasets with Spark DataFrames."""
