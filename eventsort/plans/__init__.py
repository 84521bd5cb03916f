"""Whole steps: scan, summarise, cluster, plan, apply, sort, review."""
