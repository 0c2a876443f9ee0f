"""Tessera: file archives and training corpora as Spark DataFrames."""
