"""Relational, interval, run and geometry operators on DataFrames."""
