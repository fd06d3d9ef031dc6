"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every module has one operator with
a general interface; ``queries.py`` derives the contract's digest columns.
"""
