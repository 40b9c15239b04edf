"""Parsing and analysis of statements, and DataFrame plans built from them."""
