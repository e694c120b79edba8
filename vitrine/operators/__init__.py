"""DataFrame-in, DataFrame-out jobs: joins, grouping, windows."""
