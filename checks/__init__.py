"""Registered queries, their tables derived from the given ones, and their SQL."""
