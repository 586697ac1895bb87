"""Analysis of source code and text corpora on Spark.

Operators take and return DataFrames; see the README for the list.
"""
