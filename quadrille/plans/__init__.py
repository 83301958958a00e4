"""Queries: derived views of the tables, and the operators applied to them."""
