"""Texts as unit vectors of hashed words, word pairs and letter triples, and the linear heads and index that score them.

The vectors stand in for a sentence encoder, which has no counterpart without its weights: any function
from texts to unit vectors of one width may take their place. Everything here runs on whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.kernels import SpanHash, alnum_table, code_points, mix, word_spans
from quernstone.operators import learning
from quernstone.operators.vectors import nearest_score, neighbours

DIMS = 256
#: An index up to this size is sent to every worker; a larger one is met block by block.
MOST_SHIPPED = 64 << 20
#: Characters of texts that are turned into vectors at once; a longer text is alone.
AT_ONCE = 400_000

Embed = Callable[[list[str | None]], np.ndarray]


def hashed_vectors(texts: list[str | None], dims: int = DIMS) -> np.ndarray:
    """A unit vector for each text; zeros for null, empty and blank ones."""
    out = np.zeros((len(texts), dims), np.float32)
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end] or "") <= AT_ONCE):
            held += len(texts[end] or "")
            end += 1
        codes, starts = code_points([(t or "").lower() for t in texts[at:end]])
        if len(codes):
            hashes = SpanHash(codes)
            s, e, row = word_spans(codes, starts, alnum_table())
            words = hashes.of(s, e)
            pairs = mix(words[:-1] * np.uint64(3) + mix(words[1:]))[row[1:] == row[:-1]]
            first = np.arange(max(0, len(codes) - 2))
            place = np.searchsorted(starts, first, "right") - 1
            inside = first + 3 <= starts[place + 1]
            triples = hashes.of(first[inside], first[inside] + 3)
            value = np.concatenate([words, pairs, triples])
            where = np.concatenate([row, row[:-1][row[1:] == row[:-1]], place[inside]])
            slot = where * dims + (value % np.uint64(dims)).astype(np.int64)
            sign = np.where(value >> np.uint64(63) > 0, 1.0, -1.0) * np.concatenate([np.full(len(words) + len(pairs), 1.0), np.full(len(triples), 0.3)])
            out[at:end] = np.bincount(slot, sign, (end - at) * dims).reshape(-1, dims)
        at = end
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def embedded(df: DataFrame, text_col: str, out: str = "vector", embed: Embed = hashed_vectors) -> DataFrame:
    """df with the vector of a text."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed(texts.tolist())))

    return df.withColumn(out, run(F.col(text_col)))


# -- linear heads --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Heads:
    """A linear head per label of the taxonomy, and the calibration of the attack score."""

    weights: np.ndarray
    intercepts: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.weights.T + self.intercepts

    def raw(self, vectors: np.ndarray) -> np.ndarray:
        """The raw attack score: the benign head turned round."""
        return -self.logits(vectors)[:, learning.TAXONOMY.index("benign")]

    def attack(self, vectors: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(vectors) + self.offset, -500, 500)))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(name, [float(x) for x in w], float(b), self.slope, self.offset) for name, w, b in zip(learning.TAXONOMY, self.weights, self.intercepts)]
        spark.createDataFrame(rows, "label string, weights array<double>, intercept double, slope double, offset double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Heads:
        rows = {r.label: r for r in spark.read.parquet(path).collect()}
        own = [rows[name] for name in learning.TAXONOMY]
        return cls(np.array([r.weights for r in own]), np.array([r.intercept for r in own]), own[0].slope, own[0].offset)


def fit_heads(examples: DataFrame, held_out: DataFrame | None = None, embed: Embed = hashed_vectors) -> Heads:
    """Heads fitted on a bounded sample of examples (text, target, mask), calibrated on held-out rows (text, label).

    A label that all examples agree on gets a head without weights.
    """
    shaped = embedded(examples, "text", "vector", embed).select(array_to_vector("vector").alias("features"), "target", "mask")
    models = learning.fit_heads(shaped.cache())
    shaped.unpersist()
    weights = np.array([models[name].coefficients.toArray() for name in learning.TAXONOMY])
    intercepts = np.clip(np.nan_to_num([models[name].intercept for name in learning.TAXONOMY], posinf=20, neginf=-20), -20, 20)
    heads = Heads(weights, intercepts)
    if held_out is None:
        return heads

    @F.pandas_udf("double")
    def raw(texts: pd.Series) -> pd.Series:
        return pd.Series(heads.raw(embed(texts.tolist())))

    slope, offset = learning.fit_platt(held_out.select(raw("text").alias("score"), "label"))
    return Heads(weights, intercepts, slope, offset)


# -- the index -----------------------------------------------------------------------------------


def build_index(rows: DataFrame, embed: Embed = hashed_vectors) -> DataFrame:
    """(id, text, family, vector) of the entries (id, text, family) with a text."""
    return embedded(rows.where("text IS NOT NULL").select("id", "text", "family"), "text", "vector", embed)


def save_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Models:
    """What the learned layers need; a layer without its part counts 0."""

    heads: Heads | None = None
    index: DataFrame | None = None
    embed: Embed = field(default=hashed_vectors)


_SCORES = "struct<l2:double,knn:double,nearest:string,vector:array<float>>"


def _scores(heads: Heads | None, entries: object, embed: Embed, keep: bool) -> Column:
    @F.pandas_udf(_SCORES)
    def run(texts: pd.Series) -> pd.DataFrame:
        vectors = embed(texts.tolist())
        n = len(vectors)
        blank = ~vectors.any(axis=1)
        knn, nearest = np.zeros(n), [None] * n
        if entries is not None:
            ids, matrix = entries.value
            if len(ids) and n:
                sims = vectors @ matrix.T
                best = sims.argmax(axis=1)
                knn = np.where(blank, 0.0, np.maximum(0.0, sims[np.arange(n), best].astype(np.float64)))
                nearest = [None if b else ids[i] for i, b in zip(best, blank)]
        l2 = heads.attack(vectors) if heads else np.zeros(n)
        return pd.DataFrame({"l2": l2, "knn": knn, "nearest": nearest, "vector": list(vectors) if keep else [None] * n})

    return run.asNondeterministic()


def layer_scores(df: DataFrame, id_col: str, text_col: str, models: Models, keep_vector: bool = False) -> DataFrame:
    """df with l2, knn and nearest (and the vector): the attack score of the heads and the similarity to the nearest index entry.

    Among equally similar entries the least id is nearest.
    """
    entries = None
    if models.index is not None:
        rows, width = models.index.agg(F.count("*"), F.max(F.size("vector"))).first()
        if rows * (width or 1) * 4 > MOST_SHIPPED:
            return _by_blocks(df, id_col, text_col, models, keep_vector)
        held = sorted((str(r.id), r.vector) for r in models.index.select("id", "vector").collect())
        matrix = np.array([v for _, v in held], np.float32).reshape(len(held), -1)
        entries = df.sparkSession.sparkContext.broadcast(([i for i, _ in held], matrix))
    scored = df.withColumn("_s", _scores(models.heads, entries, models.embed, keep_vector)(F.col(text_col)))
    return scored.withColumns({c: F.col("_s")[c] for c in ("l2", "knn", "nearest", *(["vector"] if keep_vector else []))}).drop("_s")


def _by_blocks(df: DataFrame, id_col: str, text_col: str, models: Models, keep_vector: bool) -> DataFrame:
    scored = df.withColumn("_s", _scores(models.heads, None, models.embed, True)(F.col(text_col))).withColumns({"l2": F.col("_s.l2"), "vector": F.col("_s.vector")}).drop("_s")
    asked = scored.where(F.exists("vector", lambda x: x != 0)).select(F.col(id_col).alias("query_id"), "vector")
    found = nearest_score(neighbours(asked, models.index, 1)).select(F.col("query_id").alias("_q"), F.col("score").alias("knn"), F.col("nearest").cast("string").alias("nearest"))
    joined = scored.join(found, F.col(id_col) == F.col("_q"), "left").drop("_q").withColumn("knn", F.coalesce("knn", F.lit(0.0)))
    return joined if keep_vector else joined.drop("vector")


