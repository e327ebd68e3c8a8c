"""Operators that prepare text for training: filtering, deduplication, tokens, search."""
