"""Readers and writers: files, extraction, metric text, question sets, keyed tables."""
