"""Operators that prepare text for training, on Spark."""
