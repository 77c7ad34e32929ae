"""Relational operators: components, healing, paths, centrality, stress tests, metrics."""
