"""Retrieval analytics over large document collections, as Spark DataFrame plans."""
