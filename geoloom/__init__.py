"""Catalogue, lease and feature jobs for geospatial datasets, written on Spark DataFrames."""
