"""Operators for large training-data corpora.

Nothing else in the library imports this subpackage; it imports nothing of the library but itself.
"""
