"""Queries over the lens tables, one for each operator, with the SQL that gives the same rows."""
