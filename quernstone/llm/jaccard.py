"""Sets of adjacent word pairs, and the exact check of candidate pairs."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from quernstone.functions.kernels import alnum_table, gap_table, pair_sets
from quernstone.operators import similarity

#: What makes up a word: letters and digits, or anything but space, tab, line feed and carriage return.
WORDS = {"alnum": alnum_table, "spaced": gap_table}


def sets_of(texts: list[str | None], words: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashed word pairs of each text and their offsets; null is like empty."""
    return pair_sets([t or "" for t in texts], WORDS[words]())


def verified(candidates: DataFrame, texts: DataFrame, words: str, threshold: float, label: str) -> DataFrame:
    """A table of the candidate pairs (a, b) whose texts (id, text) have at least the similarity, with it."""
    return similarity.verified(candidates, texts, partial(sets_of, words=words), threshold, label)
