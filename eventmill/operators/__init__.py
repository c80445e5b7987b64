"""Operators on event tables: DataFrames in, DataFrames out, with the reference time as a parameter."""
