"""Writes, series, their codec, and changes of model."""
