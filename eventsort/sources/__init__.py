"""Readers and writers of listings, registries, plans and summaries."""
