"""Operators for large text corpora: mixing, de-duplication, tokens, packing, language, fingerprints, quality, hosts, toxicity."""
