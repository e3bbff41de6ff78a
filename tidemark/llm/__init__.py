"""Training-data operators: deduplication, extraction, scanning, mixing, packing, scoring and search.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
