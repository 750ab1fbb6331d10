"""Training-data operators: scoring, near-duplicates, archives, mixing, tokens."""
