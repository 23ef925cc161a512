"""Training-data operators: extraction, identification, deduplication, mixing, encoding."""
