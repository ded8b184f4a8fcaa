"""Millrace: a PySpark-native engine for context reduction and corpus preparation."""
