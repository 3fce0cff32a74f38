"""Operators for preparing training data: media, toxicity, secrets, mixing, line dedup, PII, language ID, passages, fill-in-the-middle, conversations,
SimHash near-dedup, document fingerprints and packing. Nothing else in the library imports this subpackage."""
