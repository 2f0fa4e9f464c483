"""Operators over documents; each takes and returns Columns or DataFrames."""
