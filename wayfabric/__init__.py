"""Spatial-graph resilience analytics and corpus preparation on PySpark."""
