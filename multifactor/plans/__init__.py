"""Registered queries: compositions of operators over the given tables, with their oracle SQL."""
