"""Incremental processing over arriving files."""
