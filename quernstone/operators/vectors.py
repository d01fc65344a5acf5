"""Nearest neighbours of vectors by dot product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.plans.runtime import materialise


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; vectors of different length raise an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


#: Entries and queries of a cell: about 100 MB of similarities at most.
CELL_ENTRIES, CELL_QUERIES = 4_000, 4_000


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors as the rows of a matrix; they must have one length."""
    lengths = pa.compute.list_value_length(vectors).to_numpy()
    if lengths.min() != lengths.max():
        raise ValueError("vectors differ in length")
    return vectors.flatten().to_numpy().astype(np.float64).reshape(len(vectors), lengths[0])


def neighbours(queries: DataFrame, index: DataFrame, k: int = 5, partitions: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar vectors of the index, equals by id.

    Queries (query_id, vector) are blocks that meet every partition of the index (id, vector): each
    partition scores a block of queries by one matrix product and sends k candidates a query, and the
    best k are merged. k below 1 and an empty index give nothing.
    """
    spark = index.sparkSession
    columns = [index.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()]
    stated = materialise(queries.select("query_id", "vector").where("vector IS NOT NULL"), "queries")
    held = materialise(index.where("vector IS NOT NULL").select("id", "vector"), "index")
    parts = partitions or max(spark.sparkContext.defaultParallelism, -(-held.count() // CELL_ENTRIES))
    blocks = max(1, -(-stated.count() // CELL_QUERIES))
    cells = held.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    left = cells.select(F.lit(True).alias("entry"), "part", F.col("id").alias("id"), F.lit(None).cast(columns[1]).alias("query_id"), "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    right = stated.select(F.lit(False).alias("entry"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast(columns[0]).alias("id"), "query_id", "vector", block.alias("block"))

    def score(key: tuple, t: pa.Table) -> pa.Table:
        entry = t.column("entry").combine_chunks()
        own, asked = t.filter(entry), t.filter(pa.compute.invert(entry))
        schema = pa.schema([("query_id", t.schema.field("query_id").type), ("id", t.schema.field("id").type), ("similarity", pa.float64())])
        if not own.num_rows or not asked.num_rows:
            return schema.empty_table()
        own = own.sort_by("id")
        m, q = (_matrix(x.column("vector").combine_chunks()) for x in (own, asked))
        if m.shape[1] != q.shape[1]:
            raise ValueError("vectors differ in length")
        sims = q @ m.T
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(q)), top.shape[1])
        ids = own.column("id").take(pa.array(top.reshape(-1)))
        return pa.table([asked.column("query_id").take(pa.array(rows)), ids, pa.array(sims[rows, top.reshape(-1)])], schema=schema)

    scored = left.unionByName(right).groupBy("part", "block").applyInArrow(score, f"query_id {columns[1]}, id {columns[0]}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_score(found: DataFrame) -> DataFrame:
    """(query_id, score, nearest): the best similarity, not below 0."""
    return found.where("rank = 1").select("query_id", F.greatest(F.lit(0.0), F.col("similarity")).alias("score"), F.col("id").alias("nearest"))


def consecutive_similarity(vector_col: str, key_col: str, order_col: str) -> Column:
    """Dot product with the vector before, null for the first of a key."""
    w = Window.partitionBy(key_col).orderBy(order_col)
    before = F.lag(vector_col).over(w)
    return F.when(before.isNotNull(), dot(F.col(vector_col), before))


def index_entries(rows: DataFrame, families: DataFrame) -> DataFrame:
    """Attack rows with their first weak family, an empty one where there is none."""
    first = families.select(F.col("id").alias("_id"), F.element_at(F.concat("labels", F.array(F.lit(""))), 1).alias("family"))
    return rows.where("label = 1").join(first, F.col("id") == F.col("_id"), "left").drop("_id").fillna({"family": ""})
