"""Readers and writers: landed files in, partitioned tables and chart documents out."""
