"""codestrata: analytics over large collections of source and text files, on Spark."""

__version__ = "0.1.0"
