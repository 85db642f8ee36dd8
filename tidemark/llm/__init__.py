"""Training-data operators: deduplication, scoring, mixing, packing and token output."""
