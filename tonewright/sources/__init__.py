"""Readers and writers of text corpora."""
