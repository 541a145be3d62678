"""Operators for large training-data pipelines.

Each module holds one operator with its own general interface; ``queries.py``
holds the thin registered queries.  Nothing else in the library imports this
subpackage.
"""
