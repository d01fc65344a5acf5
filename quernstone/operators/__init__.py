"""Relational operators over matches, pairs, splits, scores and conversations."""
