"""Driver queries and staging helpers."""
