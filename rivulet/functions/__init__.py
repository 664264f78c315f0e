"""Column-level functions: normalisation, hashing, stemming, parsing."""
