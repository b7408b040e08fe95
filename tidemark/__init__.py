"""Tidemark: market-signal analytics on Spark DataFrames.

Every public operator takes DataFrames and returns a DataFrame. What reaches the driver is
bounded: catalogues, folder names, models and their samples, a benchmark block by block.
"""
