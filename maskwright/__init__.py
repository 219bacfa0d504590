"""Pseudonymisation of large document collections on Spark."""

__version__ = "0.1.0"
