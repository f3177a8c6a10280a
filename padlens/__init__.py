"""Presentation-attack-detection analytics on Spark DataFrames."""
