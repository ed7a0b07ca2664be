"""Quire: document context and translation-preparation analytics on Spark."""

__version__ = "0.1.0"
