"""Geospatial tile analytics on Spark DataFrames."""
