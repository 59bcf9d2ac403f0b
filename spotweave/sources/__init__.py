"""Readers, writers and the fixture dataset."""
