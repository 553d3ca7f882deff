"""Operators that prepare text corpora for training: filtering, deduplication, tokens and packing."""
