"""Incremental and streaming work."""
