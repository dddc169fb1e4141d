"""Training-data operators: packing, deduplication, quality, search, privacy, mixing."""
