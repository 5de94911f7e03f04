"""Operators for preparing training text: fingerprints, joins, filters, packing, formatting."""
