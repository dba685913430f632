"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing else in the library imports this package.  Every operator takes DataFrames and gives a
DataFrame; `queries` applies each of them to its whole table.
"""
