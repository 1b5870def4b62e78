"""Operators on DataFrames: catalog reads, joins, aggregates, upserts, documents, HTML, feedback."""
