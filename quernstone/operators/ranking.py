"""Ranks and running sums over a whole table without putting it into one task.

Rows are range-partitioned by the order and written with the number of their partition; only one row per
partition reaches the driver, and its running totals are added to what each partition counts by itself.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quernstone.plans.runtime import materialise

#: Bytes of the input that make up a partition.
PART_BYTES = 64 << 20


def _input_bytes(df: DataFrame) -> int:
    """Bytes of all tables that df reads, where they are known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)


def ranged(df: DataFrame, order: list[Column] | list[str], ties: list[str] | None = None) -> DataFrame:
    """df in partitions that are ranges of this order, sorted within by the order and then by `ties`."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), _input_bytes(df) // PART_BYTES)
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order, *(ties or []))


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    index = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return materialise(ranged(df, order).withColumns({"_part": F.spark_partition_id(), "_pos": index}), "ranged")


def _with_before(placed: DataFrame, per_part: DataFrame, values: list[str]) -> DataFrame:
    """placed with the totals (before_value) of values over all partitions before a row's own; one row a partition is broadcast."""
    rows = sorted(per_part.select("_part", *values).collect(), key=lambda r: r["_part"])
    totals = [[0, *accumulate(r[v] or 0 for r in rows)] for v in values]
    kinds = [per_part.schema[v].dataType.simpleString() for v in values]
    table = [(r["_part"], *(t[i] for t in totals)) for i, r in enumerate(rows)]
    if not table:
        return placed.withColumns({f"before_{v}": F.lit(0).cast(k) for v, k in zip(values, kinds)})
    before = placed.sparkSession.createDataFrame(table, "_part int, " + ", ".join(f"before_{v} {k}" for v, k in zip(values, kinds)))
    return placed.join(F.broadcast(before), "_part")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with a number from 0 in this order, which must be total."""
    placed = _placed(df, order)
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    return _with_before(placed, counts, ["n"]).withColumn(out, F.col("before_n") + F.col("_pos")).drop("_part", "_pos", "before_n")


def after_gaps(df: DataFrame, key: str, at: str, tie: str, gap: float, out: str) -> DataFrame:
    """df with the number of gaps of at least `gap` before each row of its key, in order of `at` and `tie`.

    The rows of one key may span many partitions: the last row of each is what the next one looks back to.
    """
    placed = _placed(df, [F.col(key), F.col(at), F.col(tie)])
    ends = placed.groupBy("_part").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(at).alias("t")), "_pos").alias("end"))
    rows = sorted(((r["_part"], r["end"]) for r in ends.collect()), key=lambda r: r[0])
    kind = placed.schema[key].dataType
    looked = [(p, e["k"], e["t"]) for (p, _), (_, e) in zip(rows[1:], rows[:-1])]
    back = df.sparkSession.createDataFrame(looked, StructType([StructField("_part", IntegerType()), StructField("_back_key", kind), StructField("_back_at", placed.schema[at].dataType)]))
    placed = placed.join(F.broadcast(back), "_part", "left")
    w = Window.partitionBy("_part").orderBy("_pos")
    first = F.col("_pos") == 0
    before_key, before_at = F.when(first, F.col("_back_key")).otherwise(F.lag(key).over(w)), F.when(first, F.col("_back_at")).otherwise(F.lag(at).over(w))
    broken = F.coalesce((before_key == F.col(key)) & (F.col(at) - before_at >= gap), F.lit(False))
    marked = materialise(placed.withColumn("_gap", F.when(broken, 1).otherwise(0)), "gaps")
    per = marked.groupBy("_part").agg(F.sum("_gap").alias("n"))
    counted = _with_before(marked, per, ["n"]).withColumn("_gaps", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before_n"))
    starts = counted.groupBy(F.col(key).alias("_gap_key")).agg(F.min("_gaps").alias("_least"))
    joined = counted.join(starts, F.col(key) == F.col("_gap_key"))
    return joined.withColumn(out, (F.col("_gaps") - F.col("_least")).cast("int")).drop("_part", "_pos", "_gap", "_gaps", "_gap_key", "_least", "_back_key", "_back_at", "before_n")


def before_in_key(df: DataFrame, key: str, at: str, tie: str, value: str, out: str) -> DataFrame:
    """df with the value of the row before, of the same key, in order of `at` and `tie`; null for the first.

    The rows of one key may span many partitions: each looks back to the last row of the one before.
    """
    placed = _placed(df, [F.col(key), F.col(at), F.col(tie)])
    ends = placed.groupBy("_part").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), "_pos").alias("end"))
    order = sorted(r["_part"] for r in ends.select("_part").collect())
    after = df.sparkSession.createDataFrame(list(zip(order[1:], order[:-1])), "_part int, _last int")
    back = F.broadcast(after).join(ends.withColumnRenamed("_part", "_last"), "_last").select("_part", F.col("end.k").alias("_back_key"), F.col("end.v").alias("_back"))
    w = Window.partitionBy("_part").orderBy("_pos")
    looked = placed.withColumns({"_k": F.lag(key).over(w), "_v": F.lag(value).over(w)}).join(back, "_part", "left")
    first = F.col("_pos") == 0
    same = F.when(first, F.col("_back_key")).otherwise(F.col("_k")) == F.col(key)
    return looked.withColumn(out, F.when(same, F.when(first, F.col("_back")).otherwise(F.col("_v")))).drop("_part", "_pos", "_k", "_v", "_back_key", "_back")


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running totals (name: column) in this order, which must be total; and the grand totals as all_name."""
    placed = _placed(df, order)
    per = placed.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    grand = per.agg(*[F.sum(n).alias(n) for n in sums]).first()
    columns = {n: F.sum(c).over(w) + F.col(f"before_{n}") for n, c in sums.items()}
    columns |= {f"all_{n}": F.lit(grand[n] or 0) for n in sums}
    return _with_before(placed, per, list(sums)).withColumns(columns).drop("_part", "_pos", *[f"before_{n}" for n in sums])
