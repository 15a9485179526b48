"""Operators of a training-data pipeline, as Spark jobs over documents, pages, vectors and conversations.

`operators` hold the work; `queries` registers one query of each. Nothing else in the library imports this package.
"""
