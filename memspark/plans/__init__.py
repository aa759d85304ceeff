"""Registered queries: operators over the given tables, with their SQL."""
