"""Operators for preparing training data from document collections."""
