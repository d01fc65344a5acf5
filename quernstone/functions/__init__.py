"""Column functions: normalisation, decoding, entropy, shingles."""
