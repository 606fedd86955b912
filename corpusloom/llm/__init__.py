"""Training-data operators: packing, tokenising, filtering, deduplication and redaction of large corpora."""
