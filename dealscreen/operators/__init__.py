"""Relational operators: dedup, triangulation, screen, rank, serving."""
