"""Airborne magnetic survey analytics on Spark DataFrames."""
