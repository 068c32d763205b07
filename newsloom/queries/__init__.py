"""Queries over the driver's tables, one module for each family of operators. Importing this registers all."""

from newsloom.queries import articles, composites, control, desk, events, lists, market, more, ops, rules, stored, timed  # noqa: F401
