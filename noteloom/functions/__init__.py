"""Scalar and array functions as Columns."""
