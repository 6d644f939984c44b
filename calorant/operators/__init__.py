"""Relational and domain operators, from DataFrame to DataFrame."""
