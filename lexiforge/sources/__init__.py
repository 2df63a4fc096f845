"""Scans, readers and stored tables."""
