"""Readers and writers of cell objects."""
