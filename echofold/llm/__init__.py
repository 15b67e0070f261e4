"""Operators for training-data pipelines.  Optional: nothing outside this folder imports it."""
