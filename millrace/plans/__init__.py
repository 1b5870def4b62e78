"""Registered queries."""

from . import catalogs, feeds, flows, queries, records  # noqa: F401  all fill the same registry
