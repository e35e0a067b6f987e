"""Training-data operators: scoring, formatting, packing, deduplication and mixing of text corpora."""
