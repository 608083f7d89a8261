"""Training-data operators: deduplication, mixing, tokenizing, language, archives, quality and URL rules."""
