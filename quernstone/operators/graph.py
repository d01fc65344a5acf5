"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.runtime import materialise


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the smallest id reachable over the edges, for every id in one.

    Each round joins every node's larger neighbours to its least neighbour and then every node's
    smaller ones, both as aggregates and equi-joins; a node with very many edges is only a key of an
    aggregate and of a join that adaptive execution may split.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    e, before = materialise(e, "star"), None
    while True:
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
        before = mark
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("m"))
        e = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = materialise(linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "star")
    roots = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return roots.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
