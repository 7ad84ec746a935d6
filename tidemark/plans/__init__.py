"""Queries by name, and the SQL that checks them."""
