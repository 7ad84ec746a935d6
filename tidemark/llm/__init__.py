"""Operators for preparing language-model training data.

Nothing outside this package imports it. Each operator is a module with a
general interface over DataFrames; ``registry`` holds the queries.
"""
