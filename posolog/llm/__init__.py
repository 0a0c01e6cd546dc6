"""Operators for training-data pipelines: one module for each method, `queries` for the registered forms."""
