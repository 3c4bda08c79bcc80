"""readtally: alignment quantification and training-data operators as Spark jobs."""

__version__ = "0.2.0"
