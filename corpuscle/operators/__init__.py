"""Operators on entity tables, and the queries that apply them."""
