"""Evaluation statistics over labels and scores, all as grouped aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.ranking import numbered, running
from quernstone.plans.runtime import materialise


def curve(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., score, p, tp, fp, pos, neg): positives at and cumulative counts at every distinct score, from the highest down.

    Rows shrink to one per distinct score before any window runs. Null labels or scores are left out.
    """
    by = by or []
    counted = scores.where("label IS NOT NULL AND score IS NOT NULL").groupBy(*by, "score").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("n"))
    if not by:
        c = running(counted, [F.desc("score")], {"tp": "p", "fp": "n"})
        return c.select("score", "p", "tp", "fp", F.col("all_tp").alias("pos"), F.col("all_fp").alias("neg"))
    w, whole = Window.partitionBy(*by).orderBy(F.desc("score")), Window.partitionBy(*by)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return counted.select(*by, "score", "p", F.sum("p").over(run).alias("tp"), F.sum("n").over(run).alias("fp"), F.sum("p").over(whole).alias("pos"), F.sum("n").over(whole).alias("neg"))


def tpr_at_fpr(scores: DataFrame, target: float, by: list[str] | None = None) -> DataFrame:
    """(by..., tpr): the best true-positive rate with at most that false-positive rate, 0 if there is none."""
    c = curve(scores, by)
    fpr = F.coalesce(F.try_divide(F.col("fp"), F.col("neg")), F.lit(0.0))
    tpr = F.coalesce(F.try_divide(F.col("tp"), F.col("pos")), F.lit(0.0))
    best = F.coalesce(F.max(F.when(fpr <= target, tpr)), F.lit(0.0)).alias("tpr")
    return c.groupBy(*by).agg(best) if by else c.agg(best)


def average_precision(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., average_precision): sum of recall steps times precision."""
    c = curve(scores, by)
    part = c.withColumn("part", F.try_divide(F.col("p"), F.col("pos")) * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = F.coalesce(F.sum("part"), F.lit(0.0)).alias("average_precision")
    return part.groupBy(*by).agg(out) if by else part.agg(out)


def _poisson(times: np.ndarray, resamples: int, seeds: np.ndarray) -> np.ndarray:
    """For each group of equal rows how often they occur in each resample: one draw of a Poisson law for all of them."""
    return np.stack([np.random.Generator(np.random.PCG64(int(s) & 0xFFFFFFFFFFFFFFFF)).poisson(t, resamples) for t, s in zip(times, seeds)]) if len(times) else np.zeros((0, resamples), np.int64)


def bootstrap_tpr(scores: DataFrame, target: float, resamples: int = 2000, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """(by..., tpr, low, high, resamples) with the 95 % interval of resampled rates.

    Rows of one label and score are one group, whose number of occurrences in a resample is a single draw
    from the Poisson law, seeded by the group. A resample is then one running sum over the scores, which each
    task keeps for all resamples at once: groups are range-partitioned by score, a first pass sends the
    totals of each partition, a second one starts from them.
    """
    by = by or []
    counted = scores.where("label IS NOT NULL AND score IS NOT NULL").groupBy(*by, F.col("score").cast("double").alias("score")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    counted = counted.withColumn("key", F.to_json(F.struct(*by)) if by else F.lit("")).withColumn("seed", F.xxhash64("key", "score", F.lit(seed)))
    spark = scores.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = materialise(counted.select("key", "score", "p", "n", "seed").repartitionByRange(parts, "key", F.desc("score")).sortWithinPartitions("key", F.desc("score")).withColumn("part", F.spark_partition_id()), "bootstrap")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """Draws of runs of rows of one key: (key, part, positives, negatives), rows by resamples."""
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                keys = np.array(b.column("key").to_pylist(), object)
                seeds = b.column("seed").to_numpy()
                p, n = (_poisson(b.column(c).to_numpy(), resamples, seeds ^ k) for c, k in (("p", 0), ("n", 0x5DEECE66D)))
                cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
                for x, y in zip(cuts[:-1], cuts[1:]):
                    yield keys[x], b.column("part")[0].as_py(), p[x:y], n[x:y]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for key, part, p, n in blocks(batches):
            sums[key, part] = sums.get((key, part), 0) + np.stack([p.sum(axis=0), n.sum(axis=0)])
        for (key, part), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), pa.array([s[0].astype(np.int64).tobytes()], pa.binary()), pa.array([s[1].astype(np.int64).tobytes()], pa.binary())], ["key", "part", "p", "n"])

    # one row of fixed width a key and partition
    before: dict[tuple[str, int], np.ndarray] = {}
    whole: dict[str, np.ndarray] = {}
    for r in sorted(placed.mapInArrow(totals, "key string, part int, p binary, n binary").collect(), key=lambda r: (r.key, r.part)):
        before[r.key, r.part] = whole.get(r.key, np.zeros((2, resamples), np.int64))
        whole[r.key] = before[r.key, r.part] + np.stack([np.frombuffer(r.p, np.int64), np.frombuffer(r.n, np.int64)])
    known = spark.sparkContext.broadcast((before, whole))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[str, np.ndarray] = {}
        rates: dict[str, np.ndarray] = {}
        for key, part, p, n in blocks(batches):
            start = so_far.get(key, known.value[0][key, part])
            tp, fp = start[0] + np.cumsum(p, axis=0), start[1] + np.cumsum(n, axis=0)
            so_far[key] = np.stack([tp[-1], fp[-1]])
            pos, neg = known.value[1][key]
            ok = fp <= target * neg
            tpr = np.where(ok, tp, 0) / np.maximum(pos, 1)
            rates[key] = np.maximum(rates.get(key, np.zeros(resamples)), tpr.max(axis=0))
        for key, r in rates.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(resamples, key, object), pa.string()), pa.array(np.arange(resamples)), pa.array(r)], ["key", "rep", "tpr"])

    each = placed.mapInArrow(best, "key string, rep bigint, tpr double").groupBy("key", "rep").agg(F.max("tpr").alias("tpr"))
    ends = each.groupBy("key").agg(F.percentile("tpr", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("*").alias("resamples"))
    point = tpr_at_fpr(scores, target, by)
    point = point.withColumn("key", F.to_json(F.struct(*by)) if by else F.lit(""))
    return point.join(ends, "key").select(*by, "tpr", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "resamples")


def confusion(scores: DataFrame, threshold: Column | float, by: list[str] | None = None) -> DataFrame:
    """(by..., tp, fp, tn, fn, precision, recall, fpr, f1, accuracy); a score at the threshold is positive, empty denominators give 0."""
    by = by or []
    hit, yes = F.col("score") >= threshold, F.col("label") == 1
    counts = [F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & ~yes).alias("tn"), F.count_if(~hit & yes).alias("fn")]
    kept = scores.where("label IS NOT NULL AND score IS NOT NULL")
    c = kept.groupBy(*by).agg(*counts) if by else kept.agg(*counts)
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(*by, "tp", "fp", "tn", "fn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(fp, fp + tn).alias("fpr"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), div(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion at each of a few thresholds."""
    each = scores.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return confusion(each, F.col("threshold"), ["threshold"])


# -- three definitions of a percentile -----------------------------------------------------------


def percentiles_linear(value: Column, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> Column:
    """Interpolated between neighbours."""
    return F.percentile(value, F.array(*[F.lit(s) for s in shares]))


def _ranked(df: DataFrame, value: str) -> DataFrame:
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    return running(counted, [F.col("v")], {"upto": "k"}).select("v", "upto", F.col("all_upto").alias("n"))


def percentiles_truncated(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The value at position int(n * share), the last one at most."""
    r = _ranked(df, value)
    at = lambda s: F.least(F.floor(F.col("n") * s), F.col("n") - 1)
    return r.agg(*[F.min(F.when(F.col("upto") > at(s), F.col("v"))).alias(f"p{s * 100:g}") for s in shares], F.max("n").alias("n"))


def percentiles_nearest(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The value at the rounded position (half to even) of share * (n - 1)."""
    r = _ranked(df, value)
    at = lambda s: F.bround((F.col("n") - 1) * s, 0)
    return r.agg(*[F.min(F.when(F.col("upto") > at(s), F.col("v"))).alias(f"p{s * 100:g}") for s in shares], F.max("n").alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, count) over equal widths from the least to the greatest value."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).count()


def segments(bounds: Column, text: Column) -> Column:
    """A text cut at every boundary of the spans (s, e), each piece with the numbers of the spans that cover it."""
    n = F.length(text)
    inside = lambda v: F.least(F.greatest(v, F.lit(0)), n)
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), F.flatten(F.transform(bounds, lambda b: F.array(inside(b["s"]), inside(b["e"])))))))
    pairs = F.transform(F.slice(cuts, 2, F.size(cuts)), lambda e, i: F.struct(F.element_at(cuts, i + 1).alias("s"), e.alias("e")))
    cover = lambda p: F.filter(F.transform(bounds, lambda b, i: F.when((b["s"] <= p["s"]) & (b["e"] >= p["e"]), i)), lambda x: x.isNotNull())
    return F.transform(pairs, lambda p: F.struct(F.substring(text, p["s"] + 1, p["e"] - p["s"]).alias("text"), cover(p).alias("spans")))


def ago(seconds: Column) -> Column:
    """How long ago, as people say it."""
    r = lambda d: F.floor(seconds / d + 0.5).cast("int").cast("string")
    return F.when(seconds < 5, "just now").when(seconds < 60, F.concat(r(1), F.lit("s ago"))).when(seconds < 3600, F.concat(r(60), F.lit("m ago"))).otherwise(F.concat(r(3600), F.lit("h ago")))


def reliability(scores: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, observed) over bins with edges at the quantiles of the score."""
    edges = scores.agg(F.percentile("score", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges"))
    at = F.size(F.filter("edges", lambda x: x <= F.col("score")))
    placed = scores.join(F.broadcast(edges)).withColumn("bin", at)
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("predicted"), F.avg("label").alias("observed"))


def brier(label: Column, score: Column) -> Column:
    return F.avg(F.pow(score - label, 2))


def diagnose(df: DataFrame, value: str, order: str) -> DataFrame:
    """(n, drift, suspect): whether latencies may be trusted: enough of them, no drift, no heavy tail."""
    ranked = numbered(df.where(F.col(value).isNotNull()).select(value, order), [F.col(order), F.col(value)], "pos")
    total = ranked.count()
    ranked = ranked.withColumn("half", F.when(F.col("pos") < (total + 1) // 2, 1).otherwise(2))
    a = ranked.agg(F.count("*").alias("n"), F.median(F.when(F.col("half") == 1, F.col(value))).alias("m1"), F.median(F.when(F.col("half") == 2, F.col(value))).alias("m2"), percentiles_linear(F.col(value)).alias("p"))
    drift = F.coalesce(F.try_divide(F.col("m2"), F.col("m1")), F.lit(1.0))
    why = F.array_compact(F.array(F.when(F.col("n") < 50, "few"), F.when((drift > 1.15) | (drift < 0.85), "drift"), F.when(F.col("p")[1] > 2.5 * F.col("p")[0], "tail")))
    return a.select("n", drift.alias("drift"), why.alias("suspect"))


def parity(ratio: Column) -> Column:
    """What a ratio of two run times says."""
    return F.when(ratio > 1.25, "slower").when(ratio < 0.8, "faster").otherwise("parity")
