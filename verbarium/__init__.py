"""Verbarium: a PySpark-native engine for archives of nested language records."""
