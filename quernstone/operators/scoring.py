"""Fusion of layer scores into one probability, and the ordered verdict it leads to."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYERS = ("l0", "l1", "l2", "knn")
VERDICTS = ("allow", "flag", "sanitise", "challenge", "block")
#: Default cut points from flag to block.
CUTS = (0.2, 0.4, 0.6, 0.8)


@dataclass(frozen=True)
class Weights:
    """Logistic weights; a layer without one counts nothing."""

    intercept: float = 0.0
    coefficients: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"intercept": self.intercept, "coefficients": self.coefficients}, sort_keys=True, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Weights:
        raw = json.loads(text)
        return cls(raw["intercept"], raw["coefficients"])


@dataclass(frozen=True)
class Cuts:
    """Cut points of the verdicts; they must rise strictly."""

    flag: float = CUTS[0]
    sanitise: float = CUTS[1]
    challenge: float = CUTS[2]
    block: float = CUTS[3]

    def __post_init__(self) -> None:
        if not self.flag < self.sanitise < self.challenge < self.block:
            raise ValueError("cut points must rise strictly from flag to block")


def contributions(weights: Weights, layers: tuple[str, ...] = LAYERS) -> Column:
    """What each layer adds before the logistic function."""
    used = [c for c in layers if c in weights.coefficients]
    return F.map_from_arrays(F.array(*[F.lit(c) for c in used]), F.array(*[F.col(c) * weights.coefficients[c] for c in used]))


def fuse(weights: Weights, layers: tuple[str, ...] = LAYERS) -> Column:
    z = F.lit(weights.intercept)
    for c in layers:
        z = z + F.col(c) * float(weights.coefficients.get(c, 0.0))
    return 1 / (1 + F.exp(-z))


def strongest(layers: tuple[str, ...] = LAYERS) -> Column:
    """The largest layer score and the first layer that has it."""
    value = F.greatest(*[F.col(c) for c in layers])
    driver = F.lit(layers[-1])
    for c in reversed(layers[:-1]):
        driver = F.when(F.col(c) == value, F.lit(c)).otherwise(driver)
    return F.struct(value.alias("value"), driver.alias("driver"))


def verdict_rank(score: Column, cuts: Cuts | Column = Cuts()) -> Column:
    """0 (allow) to 4 (block); a score at a cut point gets the stricter verdict."""
    cut = (lambda name: F.lit(getattr(cuts, name))) if isinstance(cuts, Cuts) else (lambda name: cuts[name])
    return F.when(score >= cut("block"), 4).when(score >= cut("challenge"), 3).when(score >= cut("sanitise"), 2).when(score >= cut("flag"), 1).otherwise(0)


def verdict_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), rank + 1)


def verdict_of(name: Column) -> Column:
    """Rank of a verdict in any letter case, null for another word."""
    position = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.lower(F.trim(name)))
    return F.when(position > 0, (position - 1).cast("int"))


def decide(df: DataFrame, score_col: str, shadow_col: str | None = None, cuts: Cuts | Column = Cuts()) -> DataFrame:
    """df with verdict, enforced and rationale; in shadow mode nothing is enforced."""
    rank = verdict_rank(F.col(score_col), cuts)
    shadow = F.coalesce(F.col(shadow_col), F.lit(False)) if shadow_col else F.lit(False)
    why = F.format_string("score %.4f reaches %s", F.col(score_col), verdict_name(rank))
    return df.withColumns({"verdict": verdict_name(rank), "enforced": ~shadow, "rationale": why})


def decide_by(df: DataFrame, score_col: str, key_col: str, policies: DataFrame) -> DataFrame:
    """Verdicts by cut points of a small policy table (key, flag, sanitise, challenge, block); others get the defaults.

    A policy whose cut points do not rise strictly raises an error.
    """
    rising = (F.col("flag") < F.col("sanitise")) & (F.col("sanitise") < F.col("challenge")) & (F.col("challenge") < F.col("block"))
    cut = F.struct("flag", "sanitise", "challenge", "block")
    own = policies.select(F.col("key").alias("_key"), F.when(rising, cut).otherwise(F.raise_error(F.lit("cut points must rise strictly"))).alias("_own"))
    default = F.struct(*[F.lit(c).alias(n) for n, c in zip(VERDICTS[1:], CUTS)])
    joined = df.join(own, F.col(key_col) == F.col("_key"), "left").withColumn("_cuts", F.coalesce("_own", default))
    return decide(joined, score_col, None, F.col("_cuts")).drop("_key", "_own", "_cuts")
