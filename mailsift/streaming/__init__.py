"""Structured Streaming jobs; each has a batch operator that gives the same table."""
