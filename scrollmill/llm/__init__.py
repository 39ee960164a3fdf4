"""Operators for preparing language-model training data, with their queries.

Nothing outside this package imports it; deleting it leaves the rest working.
"""
