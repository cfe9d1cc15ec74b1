"""Operators of a large-scale training-data pipeline over the text and vector tables.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own interface; ``queries.py`` registers the thin queries.
"""
