"""Operators for large-scale training-data pipelines, as Spark jobs.

Nothing else in the library imports this subpackage.
"""
