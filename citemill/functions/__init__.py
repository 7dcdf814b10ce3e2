"""Scalar functions as Column expressions, and the few that need Python."""
