"""millrace: evidence analytics and training-data operators expressed as Spark DataFrame programs."""

__version__ = "0.1.0"
