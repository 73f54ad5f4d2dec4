"""Registered queries: every operator on the given tables, with an SQL statement of the same result."""
