"""Training-data operators: dedup, near-dedup, tokenising, search, mixing, extraction, labelling."""
