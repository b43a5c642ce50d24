"""Scalar and array functions on columns."""
