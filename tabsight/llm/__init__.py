"""Training-data operators: fingerprints, dedup, quality, mixing, tokens, HTML, LM scores."""
