"""Operators for building training data from very large text collections.

Nothing else in the library imports this package.
"""
