"""Operators for preparing text corpora for language-model training.

Nothing else in the library imports this subpackage. Every operator is a
function from DataFrames to a DataFrame; `catalog` holds the registered
queries and their DuckDB twins.
"""
