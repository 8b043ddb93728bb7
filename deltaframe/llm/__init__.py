"""Operators for large training-data pipelines.

Nothing outside this package imports it; it can be removed as a whole.  Each
module holds one operator with its general interface; ``queries`` registers the
thin queries over the test tables.
"""
