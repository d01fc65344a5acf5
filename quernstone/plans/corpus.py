"""A corpus from rows: clusters computed from the texts, partitions without leaks, the audit as a gate, the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import corpus
from quernstone.plans.runtime import materialise


def clustered(rows: DataFrame, backbone: str) -> DataFrame:
    """rows (id, text, source, source_split, ...) with `partition` and the `cluster` that their texts give, computed once."""
    each = materialise(corpus.clusters(rows, "id", "text").dropDuplicates(["id"]), "clusters")
    placed = rows.withColumn("partition", corpus.target_partition(F.col("source"), F.col("source_split"), backbone))
    return placed.join(each, "id", "left")


def build(rows: DataFrame, backbone: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept rows, findings, manifest); raises if a cluster is left in more than one partition."""
    assigned = materialise(clustered(rows, backbone), "assigned")
    kept = materialise(corpus.remediate(assigned).where("kept").drop("kept"), "kept")
    if leaks := corpus.leaking_clusters(kept).count():
        raise RuntimeError(f"{leaks} clusters are in more than one partition after remediation")
    return kept, corpus.findings(assigned), corpus.manifest(kept)
