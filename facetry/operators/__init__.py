"""Operators on query results."""
