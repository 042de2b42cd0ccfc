"""Operators that prepare text, pages and vectors for training language models.

Nothing else in the package imports this one. Every operator is a function from DataFrames to a DataFrame; the
queries that apply them to the test tables are in ``queries``, their DuckDB counterparts in ``oracle``.
"""
