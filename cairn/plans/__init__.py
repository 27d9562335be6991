"""Queries by name, with the SQL that they are compared with."""
