"""Operators for preparing language-model training text.

Nothing outside this folder imports it. Each operator takes and returns
DataFrames; ``queries.py`` holds the thin registered queries.
"""
