"""Operators for preparing large text collections as training data.

Nothing outside this subpackage imports it.
"""
