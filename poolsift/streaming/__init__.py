"""Incremental versions of per-row work."""
