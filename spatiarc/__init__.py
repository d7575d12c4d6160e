"""Spatial displacement analytics on Spark, as lazy DataFrame plans."""
