"""Operators for training data: search, deduplication, scoring, mixing, counting, packing and sharding of documents."""
