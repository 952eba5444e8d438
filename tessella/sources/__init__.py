"""Readers and writers of alignment, annotation and sequence files."""
