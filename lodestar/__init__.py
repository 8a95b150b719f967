"""Lodestar: document analytics and hybrid retrieval on PySpark."""
