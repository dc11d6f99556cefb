"""Spatial-plan analytics expressed with the DataFrame, SQL and Structured Streaming APIs."""
