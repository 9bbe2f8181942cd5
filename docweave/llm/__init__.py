"""Operators for preparing large text corpora as training data.

Nothing outside this subpackage imports it.
"""
