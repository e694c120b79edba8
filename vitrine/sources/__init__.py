"""Readers for exports and capture results, and the append-only sinks."""
