"""Hierarchical-grid analytics expressed as Spark DataFrame plans."""
