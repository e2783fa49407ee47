"""Operators for large training-data pipelines, numbered as in the README.

Nothing else in the library imports this subpackage.
"""
