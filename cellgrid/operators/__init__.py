"""Operators on cell objects: each takes and returns DataFrames."""
