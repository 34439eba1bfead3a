"""Column expressions: parsing, aggregates, changes."""
