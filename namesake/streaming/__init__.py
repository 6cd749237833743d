"""Incremental runs over arriving articles."""
