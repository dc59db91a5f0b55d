"""Apotheca: a PySpark-native analytics engine for a medicines catalogue and its event streams."""
