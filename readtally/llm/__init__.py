"""Operators of large training-data pipelines, as Spark jobs. Nothing else in the library imports this subpackage."""
