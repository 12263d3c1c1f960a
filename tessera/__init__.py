"""Raster and experiment analytics on Spark DataFrames."""
