"""Readers and writers of the records and tables."""
