"""Catalogue quality checks and item matching as PySpark DataFrame functions."""
