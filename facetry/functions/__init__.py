"""Dates, templates and formula translation."""
