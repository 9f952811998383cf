"""Lodestone: set-at-a-time document retrieval, grounded answering and corpus preparation on Spark."""

__version__ = "0.1.0"
