"""Incremental runs of the batch jobs over arriving files."""
