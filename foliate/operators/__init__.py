"""Relational, search, graph, task, feed and usage operators: DataFrames in, a DataFrame out."""
