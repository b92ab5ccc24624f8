"""Operators over change-event DataFrames."""
