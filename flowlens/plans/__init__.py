"""Composite plans: the registered query catalog and multi-output jobs."""
