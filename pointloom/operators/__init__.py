"""Operators over point DataFrames."""
