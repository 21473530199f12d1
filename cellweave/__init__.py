"""Topological data analysis on Spark DataFrames."""
