"""vitrine: exposure analytics over captured directory listings, as Spark DataFrame jobs."""
