"""Operators on quote, cell, route and index tables."""
