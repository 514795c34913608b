"""Named queries: each takes (spark, data directory) and returns a DataFrame."""
