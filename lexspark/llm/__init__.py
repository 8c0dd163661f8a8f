"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
Each module holds one operator with its own general interface; ``queries`` holds the
thin queries with fixed result columns.
"""
