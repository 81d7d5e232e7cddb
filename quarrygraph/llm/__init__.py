"""Operators of a training-data pipeline: tokenising, deduplication, packing, filtering.

Nothing outside this subpackage imports it; the driver entry adds its queries
only if it can be imported.
"""
