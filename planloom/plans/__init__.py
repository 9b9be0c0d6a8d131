"""Pipelines of operators, and the query catalogue."""
