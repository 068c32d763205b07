"""Parsers of feeds and pages."""
