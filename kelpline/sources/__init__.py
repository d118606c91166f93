"""Contracts of the sources, readers and the table store."""
