"""Operators that prepare text for training: mixing, cleaning, deduplication, search and scoring."""
