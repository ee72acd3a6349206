"""Training-data operators: fingerprints, near-duplicates, secrets, packing, language, tokens, mixing and extraction."""
