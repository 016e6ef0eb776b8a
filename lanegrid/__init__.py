"""Freight rate-card and coverage analytics on Spark DataFrames."""
