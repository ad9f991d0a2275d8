"""Readers and writers; nothing outside this package and ``streaming`` writes."""
