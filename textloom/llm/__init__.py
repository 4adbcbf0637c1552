"""Operators for training-data pipelines; optional, imported by nothing else in the library."""
