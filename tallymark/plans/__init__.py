"""Marts and the registered queries."""
