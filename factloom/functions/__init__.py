"""Scalar functions: builders that take and return Spark columns."""
