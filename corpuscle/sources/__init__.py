"""Readers of tables, files and markup."""
