"""Training-corpus operators: mixing, deduplication, packing, filters and output."""
