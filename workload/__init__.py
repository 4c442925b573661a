"""Queries over the driver's tables, each with an equivalent ANSI SQL text."""
