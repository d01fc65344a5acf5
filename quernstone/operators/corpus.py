"""Building a corpus: shingles, clusters of similar rows, partitions without leaks, audits, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.columns import let
from quernstone.operators.graph import components
from quernstone.operators.ranking import numbered
from quernstone.operators.similarity import shingle_sets, similar_pairs, verified
from quernstone.plans.runtime import materialise

PARTITIONS = ("train", "validation", "test", "cross_source_eval", "hard_negatives_eval")
SIMILARITY = 0.5
SMALL_CLUSTER, SAMPLED_PAIRS, SAMPLED_MEMBERS = 12, 40, 160


def shingle_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def shingles(text: Column, k: int = 2) -> Column:
    """Distinct runs of k words; all words of a shorter text; a mark for a text without words."""
    def of(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
        short = F.when(F.size(words) == 0, F.array(F.lit("<empty>"))).otherwise(F.array(F.array_join(words, " ")))
        return F.array_distinct(F.when(F.size(words) >= k, runs).otherwise(short))

    return let(F.regexp_extract_all(shingle_text(text), F.lit("[a-z0-9]+"), F.lit(0)), of)


def jaccard(a: Column, b: Column) -> Column:
    return let(F.size(F.array_intersect(a, b)), lambda shared: shared / (F.size(a) + F.size(b) - shared))


def clusters(rows: DataFrame, id_col: str, text_col: str, threshold: float = SIMILARITY) -> DataFrame:
    """(id, cluster) of every row: similar rows chained together, dissolved where they do not cohere.

    Cohesion is the mean similarity of all pairs of a cluster of at most twelve, of forty drawn pairs of a
    larger one. The pairs are drawn from the members whose hash is below SAMPLED_MEMBERS / n, so no task
    ranks a whole cluster. Numbers rank the clusters by their least id.
    """
    linked = materialise(components(similar_pairs(rows, id_col, text_col, threshold), "a", "b"), "linked")
    sized = linked.join(linked.groupBy("component").agg(F.count("*").alias("n")), "component")
    share = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    drawable = sized.where((F.col("n") <= SMALL_CLUSTER) | (share * F.col("n") < SAMPLED_MEMBERS))
    members = materialise(drawable.withColumn("pos", F.row_number().over(Window.partitionBy("component").orderBy("id"))), "drawable")
    draw = lambda c, j, k: F.conv(F.substring(F.md5(F.concat_ws(":", c, j, F.lit(k))), 1, 8), 16, 10).cast("long")
    shapes = members.groupBy("component").agg(F.max("n").alias("n"), F.count("*").alias("s"))
    small = shapes.where(F.col("n") <= SMALL_CLUSTER).select("component", F.explode(F.sequence(F.lit(1), F.col("s") - 1)).alias("i"), "s").select("component", "i", F.explode(F.sequence(F.col("i") + 1, F.col("s"))).alias("j"))
    large = shapes.where((F.col("n") > SMALL_CLUSTER) & (F.col("s") > 1)).select("component", "s", F.explode(F.sequence(F.lit(1), F.lit(SAMPLED_PAIRS))).alias("d"))
    first = draw(F.col("component"), F.col("d"), 0) % F.col("s")
    second = (first + 1 + draw(F.col("component"), F.col("d"), 1) % (F.col("s") - 1)) % F.col("s")
    large = large.select("component", (first + 1).cast("long").alias("i"), (second + 1).cast("long").alias("j"))
    pairs = small.select("component", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).unionByName(large)
    named = members.select("component", F.col("pos").cast("long").alias("pos"), "id")
    a = pairs.join(named.select("component", F.col("pos").alias("i"), F.col("id").alias("a")), ["component", "i"])
    ab = materialise(a.join(named.select("component", F.col("pos").alias("j"), F.col("id").alias("b")), ["component", "j"]).select("component", "a", "b"), "drawn")
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    scored = verified(ab.select("a", "b").distinct(), texts, shingle_sets, 0.0, "scored")
    means = ab.join(scored, ["a", "b"], "left").groupBy("component").agg(F.avg(F.coalesce("similarity", F.lit(0.0))).alias("mean"))
    kept = linked.join(means.where(F.col("mean") >= threshold).select("component"), "component", "left_semi")
    every = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).join(kept, "id", "left").select("id", F.coalesce("component", "id").alias("first"))
    firsts = numbered(every.select("first").distinct(), [F.col("first")], "cluster")
    return every.join(firsts, "first").select("id", F.col("cluster").cast("int").alias("cluster"))


def target_partition(source: Column, split: Column, backbone: str, hard: str = "hard_negatives") -> Column:
    """Hard negatives and other sources have evaluation partitions of their own; the backbone keeps its splits."""
    own = F.when(split.isin("train", "validation", "test"), split).otherwise("test")
    return F.when(source == hard, "hard_negatives_eval").when(source == backbone, own).otherwise("cross_source_eval")


def remediate(assigned: DataFrame) -> DataFrame:
    """assigned (id, partition, cluster, ...) with `kept`: one row per cluster, in the partition that comes first.

    Rows without a cluster are kept and take no part in the join; a cluster sends one row to it.
    """
    priority = F.array_position(F.array(*[F.lit(p) for p in PARTITIONS]), F.col("partition"))
    place = F.struct(priority.alias("at"), F.col("id").alias("id"))
    best = assigned.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min(place).alias("_best"))
    within = assigned.where("cluster IS NOT NULL").join(best, "cluster").withColumn("kept", place == F.col("_best")).drop("_best")
    return within.select(*assigned.columns, "kept").unionByName(assigned.where("cluster IS NULL").withColumn("kept", F.lit(True)))


def findings(assigned: DataFrame) -> DataFrame:
    """(cross_split_clusters_remediated, within_split_duplicates_collapsed, dropped) of assigned rows."""
    per = assigned.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("partition").alias("parts"))
    return per.agg(
        F.count_if(F.col("parts") > 1).alias("cross_split_clusters_remediated"),
        F.count_if((F.col("parts") == 1) & (F.col("n") > 1)).alias("within_split_duplicates_collapsed"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"),
    )


def leaking_clusters(assigned: DataFrame) -> DataFrame:
    """(cluster, partitions, rows) of clusters in more than one partition."""
    per = assigned.where("cluster IS NOT NULL").groupBy("cluster").agg(F.countDistinct("partition").alias("partitions"), F.count("*").alias("rows"))
    return per.where("partitions > 1")


def leaking_rows(assigned: DataFrame) -> DataFrame:
    """The rows of clusters in more than one partition."""
    return assigned.join(leaking_clusters(assigned).select("cluster"), "cluster", "left_semi")


def naive_leakage(clustered: DataFrame, seed: int = 0) -> DataFrame:
    """(leakage): the share of test rows of a random 80/10/10 split whose cluster is in its training part.

    The split is by rank of a hash of the id.
    """
    placed = numbered(clustered, [F.md5(F.concat(F.lit(f"{seed}:"), "id")), F.col("id")], "r")
    n = placed.count()
    first, second = int(n * 0.8), int(n * 0.8) + int(n * 0.1)
    train = placed.where(F.col("r") < first).select("cluster").distinct().withColumn("hit", F.lit(1))
    test = placed.where(F.col("r") >= second).select("cluster")
    return test.join(train, "cluster", "left").agg(F.coalesce(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6), F.lit(0.0)).alias("leakage"))


def content_hash(rows: DataFrame, key_col: str, columns: list[str]) -> DataFrame:
    """(key, sha256): a hash of all rows of a key whatever their order.

    The row hashes are added up in four parts of 60 bits, so the hash of a key is one partial aggregate and
    no task holds its rows.
    """
    line = rows.select(F.col(key_col).alias("key"), F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    sums = line.groupBy("key").agg(*parts, F.count("*").alias("n"))
    return sums.select("key", F.sha2(F.concat_ws(":", *[F.col(f"s{k}").cast("string") for k in range(4)], F.col("n").cast("string")), 256).alias("sha256"))


def manifest(rows: DataFrame, key_col: str = "partition") -> DataFrame:
    """One row per partition: rows, counts by label and source, licences, tiers and a content hash."""
    counts = lambda c: rows.groupBy(key_col, F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("k")).count().groupBy(key_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias(f"{c}s"))
    base = rows.groupBy(key_col).agg(F.count("*").alias("row_count"), F.array_sort(F.collect_set("license")).alias("licenses"), F.array_sort(F.collect_set("tier")).alias("tiers"))
    hashed = content_hash(rows, key_col, ["id", "text", "label", "source", "source_split", "license", "tier"]).withColumnRenamed("key", key_col)
    return base.join(counts("label"), key_col).join(counts("source"), key_col).join(hashed, key_col)
