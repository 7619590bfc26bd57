"""Orrery: iterative graph analytics with private aggregation, expressed in Spark DataFrames."""
