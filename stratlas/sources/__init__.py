"""Readers and writers of the catalogue's outside formats."""
