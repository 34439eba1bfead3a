"""Schemas, dimensions, readers and writers."""
