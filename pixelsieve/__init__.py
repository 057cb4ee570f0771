"""Curation of large file collections with Spark: quality rules, exact and perceptual de-duplication, set operations."""
