"""Operators for large training-data pipelines; the rest of the library never imports this package."""
