"""Training-data operators: archives, fingerprints, dedup, tokens, language, scoring."""
