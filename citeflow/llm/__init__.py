"""Training-data operators: deduplication, tokenizing, scoring, masking, mixing, search and formatting."""
