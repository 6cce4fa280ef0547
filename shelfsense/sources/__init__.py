"""Readers and writers of the record tables."""
