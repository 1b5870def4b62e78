"""Readers of feeds, documents and labelled rows."""
