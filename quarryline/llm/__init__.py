"""Training-data operators: dedup, privacy, mixing, fingerprints, tagging, language, encoding, secrets, decontamination, divergence, conversations."""
