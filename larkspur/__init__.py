"""Recommendation, bipartite-graph and relational analytics as DataFrame operations."""
