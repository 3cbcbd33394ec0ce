"""Registered queries, and the small world that they derive from the given tables."""
