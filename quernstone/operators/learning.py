"""Weak labels, masked losses, linear heads, calibration."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels of a target, in their order.
TAXONOMY = ("direct_override", "role_play_jailbreak", "system_prompt_extraction", "data_exfiltration", "tool_abuse", "encoding_evasion", "indirect_injection", "benign")


def weak_label(label: Column, labels: Column) -> Column:
    """The target of a row: the benign bit, or a bit per label that a rule found; null if none did."""
    benign = F.array(*[F.lit(int(t == "benign")) for t in TAXONOMY])
    hot = F.array(*[F.array_contains(labels, t).cast("int") if t != "benign" else F.lit(0) for t in TAXONOMY])
    known = F.arrays_overlap(labels, F.array(*[F.lit(t) for t in TAXONOMY[:-1]]))
    return F.when(label == 0, benign).when(label.isNotNull() & F.coalesce(known, F.lit(False)), hot)


def coverage(rows: DataFrame, by: str) -> DataFrame:
    """(by, total, benign, labelled, excluded, exclusion_rate) of rows (label, target)."""
    a = rows.where("label IS NOT NULL").groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("label") == 0).alias("benign"), F.count_if((F.col("label") == 1) & F.col("target").isNotNull()).alias("labelled"), F.count_if((F.col("label") == 1) & F.col("target").isNull()).alias("excluded"))
    return a.withColumn("exclusion_rate", F.coalesce(F.try_divide(F.col("excluded"), F.col("labelled") + F.col("excluded")), F.lit(0.0)))


def training_examples(rows: DataFrame, weak: DataFrame) -> DataFrame:
    """(id, target, mask): rows joined with weak targets; without one only the benign bit is trusted."""
    last = weak.groupBy(F.col("id").alias("_id")).agg(F.max("target").alias("weak"))
    zeros, only = F.array(*[F.lit(0.0)] * 8), F.array(*[F.lit(0.0)] * 7, F.lit(1.0))
    joined = rows.join(last, F.col("id") == F.col("_id"), "left")
    return joined.select("id", F.coalesce(F.col("weak").cast("array<double>"), zeros).alias("target"), F.when(F.col("weak").isNull(), only).otherwise(F.array(*[F.lit(1.0)] * 8)).alias("mask"))


def stable_bce(logit: Column, target: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def masked_bce(logits: Column, targets: Column, masks: Column) -> tuple[Column, Column]:
    """Loss and weight of one row; a batch's loss is sum(loss) / max(sum(weight), 1)."""
    losses = F.zip_with(F.zip_with(logits, targets, stable_bce), masks, lambda x, m: x * m)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return total(losses), total(masks)


def batch_loss(rows: DataFrame, by: str) -> DataFrame:
    """(by, loss) of rows (logits, target, mask)."""
    loss, weight = masked_bce(F.col("logits"), F.col("target"), F.col("mask"))
    return rows.select(by, loss.alias("l"), weight.alias("w")).groupBy(by).agg((F.sum("l") / F.greatest(F.sum("w"), F.lit(1.0))).alias("loss"))


def mean_loss(rows: DataFrame, by: str) -> DataFrame:
    """(loss): the mean of the losses of the batches, as an evaluation reports it."""
    return batch_loss(rows, by).agg(F.avg("loss").alias("loss"))


def text_features(features: int = 1 << 14) -> Pipeline:
    """Hashed words and word pairs."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(inputCol="words", outputCol="f1", numFeatures=features, binary=True),
        HashingTF(inputCol="pairs", outputCol="f2", numFeatures=features, binary=True),
        VectorAssembler(inputCols=["f1", "f2"], outputCol="features"),
    ])


def fit_heads(examples: DataFrame, penalty: float = 1e-3) -> dict[str, LogisticRegressionModel]:
    """One logistic head per label over examples (features, target, mask): the masked loss of independent heads is their sum."""
    heads = {}
    for k, name in enumerate(TAXONOMY):
        own = examples.select("features", F.col("target")[k].alias("label"), F.col("mask")[k].alias("weight")).where("weight > 0")
        heads[name] = LogisticRegression(regParam=penalty, weightCol="weight", maxIter=30).fit(own)
    return heads


def fit_logistic(rows: DataFrame, columns: list[str], label: str = "label", strength: float = 1.0) -> tuple[float, dict[str, float]]:
    """Intercept and coefficients of a penalised logistic fit; the penalty is that of an inverse strength over all rows."""
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(rows.select(*columns, F.col(label).cast("double").alias("label")))
    n = data.count()
    model = LogisticRegression(regParam=1 / (strength * max(n, 1)), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=1000).fit(data)
    return model.intercept, dict(zip(columns, (float(x) for x in model.coefficients)))


def fit_platt(rows: DataFrame, score: str = "score", label: str = "label") -> tuple[float, float]:
    """Slope and offset of the calibration sigmoid."""
    offset, coefficients = fit_logistic(rows.withColumn("_x", F.col(score)), ["_x"], label, 1e6)
    return coefficients["_x"], offset


def calibrated(score: Column, slope: float, offset: float) -> Column:
    return 1 / (1 + F.exp(-(score * slope + offset)))


def agreement(a: Column, b: Column) -> Column:
    """Share of rows on which two logits take the same side."""
    return F.avg(((a < 0) == (b < 0)).cast("double"))
