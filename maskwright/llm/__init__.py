"""Training-data operators: scoring, extraction, filtering, mixing, packing and deduplication of text corpora."""
