"""Training-data operators: deduplication, tokenising, sharding, formatting, scans, mixing, archives.

Nothing outside this package imports it.
"""
