"""Scalar functions, all returning Column expressions."""
