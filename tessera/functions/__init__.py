"""Scalar functions: every one takes and returns Columns."""
