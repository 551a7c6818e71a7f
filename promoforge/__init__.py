"""Promotional-offer analytics on Spark DataFrames."""
