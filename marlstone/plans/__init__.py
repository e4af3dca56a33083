"""Requests built to lazy DataFrames, and the queries that the driver runs."""
