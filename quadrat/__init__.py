"""Quadrat: all-pairs analytics on Spark.

Given items and a comparison, the engine evaluates the comparison for every
unordered pair and returns the results as a DataFrame; see quadrat.engine.
"""
