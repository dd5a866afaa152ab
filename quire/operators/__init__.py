"""Operators over query results."""
