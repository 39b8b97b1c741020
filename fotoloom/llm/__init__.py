"""Operators that prepare text for training: filters, deduplication, packing, sharding."""
