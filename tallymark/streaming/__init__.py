"""Incremental file feeds."""
