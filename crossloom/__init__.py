"""Genome-scan analytics and training-data operators on Spark DataFrames."""
