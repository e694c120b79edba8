"""Checks over the given tables: Spark views, registered queries, and their SQL."""
