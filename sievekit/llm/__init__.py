"""Training-data operators: deduplication, filtering, mixing, tokens, archives, models."""
