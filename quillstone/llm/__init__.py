"""Operators for large training-corpus pipelines.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns DataFrames; ``queries`` holds the thin registered queries.
"""
