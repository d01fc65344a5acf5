"""Corpus preparation for training language models: copies, splits, overlaps, groups, encoding, packing, repair."""
