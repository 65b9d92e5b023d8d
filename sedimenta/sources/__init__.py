"""Readers of journals, and the relations derived from the shared tables."""
