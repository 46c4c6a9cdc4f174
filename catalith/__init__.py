"""Catalog resolution and corpus preparation on Spark."""
