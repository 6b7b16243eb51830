"""Column-level building blocks (IP parsing, time windows, code labels)."""
