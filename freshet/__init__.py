"""Freshet: a Spark-native engine for station observations, written as DataFrame and Column operations."""

__version__ = "0.1.0"
