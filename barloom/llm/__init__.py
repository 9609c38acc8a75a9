"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; `queries.py` holds the
thin queries that the registry adds when the subpackage is present.
"""
