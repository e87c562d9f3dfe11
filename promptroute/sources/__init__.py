"""Readers of prompt corpora and writers of results."""
