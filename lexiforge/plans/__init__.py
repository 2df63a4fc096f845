"""Composed plans: the retrieval pipeline and the query catalogue."""
