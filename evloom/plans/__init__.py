"""Queries: each family in a module, registered with the SQL that gives the same rows."""
