"""Training-data operators: formatting, near-dedup, packing, language ID, extraction, tokens, PII."""
