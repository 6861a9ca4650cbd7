"""Spark-native analytics over recurring budget publications.

Everything is a function from DataFrames to DataFrames (or Columns to Columns):
``functions`` holds column expressions, ``sources`` reading, writing and
rebuilding tables, ``operators`` the reusable table operators, ``plans`` the
composed user-facing queries, ``streaming`` the incremental wrapper.
"""

__version__ = "0.1.0"
