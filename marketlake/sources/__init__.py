"""Readers and writers: topics, lake tables, dimensions, catalog."""
