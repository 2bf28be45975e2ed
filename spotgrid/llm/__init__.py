"""Operators of a training-data pipeline: archives, shards, near-duplicates, tokens, quality, mixing, search, chat."""
