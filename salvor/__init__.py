"""Lineage-driven recovery analytics on Spark DataFrames."""
