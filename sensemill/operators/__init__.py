"""Relational building blocks: filters, ordinal sorts, merges, search channels, graphs, learning state."""
