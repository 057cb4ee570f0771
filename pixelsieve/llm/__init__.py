"""Operators for building training data: neighbours, near-duplicates, grouping, membership, tokens, packing, shared spans."""
