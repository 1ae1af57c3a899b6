"""Operators for preparing text as training data."""
