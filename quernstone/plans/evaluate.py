"""Train the learned layers, score labelled rows by all four, refit the fusion with and without single layers, and report.

The classifier is fitted on a bounded sample (SAMPLE rows by the hash of their id); everything else covers
all rows. Interval ends come from resamples drawn by hashes, so a report is the same in every run.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import adaptive, learning, rules as R, scoring, statistics as S
from quernstone.operators.embedding import Models, build_index, fit_heads
from quernstone.plans.detect import detect, matched
from quernstone.plans.runtime import materialise

#: Labelled training rows, and held-out rows for the calibration, that the classifier is fitted on at most.
SAMPLE = 5_000
#: False-positive rates of the headline figures.
RATES = (0.001, 0.01)
#: Layers that are left out in turn.
ABLATED = ("l0", "knn")


def sample_of(rows: DataFrame, split: str, most: int = SAMPLE) -> DataFrame:
    """At most so many labelled rows (id, text, label) of a split, by the hash of their id."""
    own = rows.where((F.col("source_split") == split) & F.col("label").isNotNull() & F.col("text").isNotNull())
    return own.select("id", "text", "label").orderBy(F.md5(F.col("id").cast("string")), "id").limit(most)


def weak_targets(rows: DataFrame) -> DataFrame:
    """(id, label, target) of rows (id, text, label): what the rules say about them, null where a row is left out."""
    found = matched(rows.withColumn("_scope", F.lit("user")), "text", "_scope")
    labels = F.coalesce(R.label_set(F.transform("matches", lambda x: x["labels"])), F.array().cast("array<string>"))
    return found.select("id", "label", learning.weak_label(F.col("label"), labels).alias("target"))


def train(rows: DataFrame, entries: DataFrame, most: int = SAMPLE) -> Models:
    """Heads fitted on weak targets of the training rows and calibrated on validation rows, and the index of known attacks.

    `rows` is (id, text, label, source_split), `entries` (id, text, family).
    """
    own = materialise(sample_of(rows, "train", most), "sample")
    weak = materialise(weak_targets(own), "weak").where("target IS NOT NULL").select("id", "target")
    # without a weak label only the benign bit is trusted, and that is the label itself
    benign = F.when(F.element_at("mask", 1) == 0, F.concat(F.slice("target", 1, 7), F.array((1 - F.col("label")).cast("double")))).otherwise(F.col("target"))
    examples = own.join(learning.training_examples(own.select("id", "label"), weak), "id").select("text", benign.alias("target"), "mask")
    held = materialise(sample_of(rows, "validation", most), "held")
    both = held.select("label").distinct().count() == 2
    return Models(fit_heads(examples, held.select("text", "label") if both else None), build_index(entries))


def layers(rows: DataFrame, models: Models, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, l0, l1, l2, knn, keep...) of all rows (id, text) that are acceptable."""
    scored = detect(rows.withColumn("_scope", F.lit("user")), "id", "text", "_scope", models=models, keep=keep)
    return scored.select("id", *scoring.LAYERS, *keep)


def fusions(scored: DataFrame, ablated: tuple[str, ...] = ABLATED) -> dict[str, scoring.Weights]:
    """The weights fitted on the validation rows of scored rows, with all layers and without each of the given ones."""
    rows = scored.where((F.col("source_split") == "validation") & F.col("label").isNotNull())
    out = {}
    chosen = {"fused": list(scoring.LAYERS)} | {f"without {c}": [x for x in scoring.LAYERS if x != c] for c in ablated}
    for name, columns in chosen.items():
        out[name] = scoring.Weights(*learning.fit_logistic(rows, columns))
    return out


def variants(scored: DataFrame, weights: dict[str, scoring.Weights]) -> DataFrame:
    """(variant, id, label, score) of the fusions, the strongest layer and the rules alone."""
    every: dict[str, Column] = {name: scoring.fuse(w) for name, w in weights.items()} | {"strongest": scoring.strongest()["value"], "rules": F.col("l1")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.round(c.cast("double"), 9).alias("score")) for n, c in every.items()]))
    return scored.select("id", "label", each.alias("x")).select("x.variant", "id", "label", "x.score")


def headline(scored: DataFrame, weights: dict[str, scoring.Weights], rates: tuple[float, ...] = RATES, resamples: int = 2000) -> DataFrame:
    """(variant, fpr, average_precision, tpr, low, high): every variant at every rate, with the 95 % interval, on the test rows."""
    test = materialise(variants(scored.where((F.col("source_split") == "test") & F.col("label").isNotNull()), weights), "variants")
    ap = S.average_precision(test, ["variant"])
    parts = [S.bootstrap_tpr(test, rate, resamples, by=["variant"]).withColumn("fpr", F.lit(rate)) for rate in rates]
    return reduce(DataFrame.unionByName, parts).join(ap, "variant").select("variant", "fpr", "average_precision", "tpr", "low", "high")


def evaded(climbed: DataFrame) -> DataFrame:
    """(seeds, evaded, rate, mean_queries) of a climb; the mean is over the seeds that evaded."""
    return climbed.agg(F.count("*").alias("seeds"), F.count_if("evaded").alias("evaded"), F.avg(F.col("evaded").cast("double")).alias("rate"), F.avg(F.when(F.col("evaded"), F.col("queries"))).alias("mean_queries"))


def red_team(paraphrased: DataFrame, climbed: DataFrame) -> dict[str, dict]:
    """The two adaptive attacks as one record: of `adaptive.evasion` and of `evaded`."""
    first = paraphrased.first().asDict()
    rate = lambda a, b: a / b if b else 0.0
    return {"paraphrases": first | {"variant_rate": rate(first["evading"], first["variants"]), "seed_rate": rate(first["evaded_seeds"], first["seeds"])}, "search": evaded(climbed).first().asDict()}


def markdown(record: dict[str, dict]) -> str:
    """A red-team record as tables."""
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else "–" if v is None else str(v)
    return "\n\n".join(f"## {name}\n\n| figure | value |\n|-|-:|\n" + "\n".join(f"| {k.replace('_', ' ')} | {show(v)} |" for k, v in own.items()) for name, own in record.items()) + "\n"


def write_results(path: str, scored: DataFrame, report: DataFrame, weights: dict[str, scoring.Weights], record: dict[str, dict] | None = None) -> None:
    """The scores of all rows (`path`/scores), the report, the weights and the red-team record (`path`/results, one JSON line)."""
    scored.write.mode("overwrite").json(f"{path}/scores")
    lines = [r.asDict() for r in report.orderBy("variant", "fpr").collect()]
    whole = {"headline": lines, "weights": {n: json.loads(w.to_json()) for n, w in weights.items()}, "red_team": record}
    spark: SparkSession = scored.sparkSession
    spark.createDataFrame([(json.dumps(whole, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/results")


def paraphrased(seeds: DataFrame, score: object, threshold: float = 0.8) -> DataFrame:
    """How many one-step paraphrases of the seeds (id, text) score below the threshold."""
    return adaptive.evasion(seeds, score(adaptive.paraphrases(seeds, "id", "text").select("id", "text")), threshold)
