"""Training-data operators: filtering, deduplication, mixing, extraction and sharding of text.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
