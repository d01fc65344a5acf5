"""Streams: conversation risk with a record per key, output scanned chunk by chunk, recent decisions, counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quernstone.operators import conversation as C
from quernstone.plans.runtime import materialise, release

def _fs(spark: SparkSession, path: str) -> tuple:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _before(spark: SparkSession, path: str, epoch: int, schema: StructType) -> DataFrame | None:
    """The table that the epoch before this one left under `path`; None where there is none yet."""
    held = f"{path}/{epoch - 1}"
    files, jpath = _fs(spark, held)
    return spark.read.schema(schema).parquet(held) if epoch and files.exists(jpath) else None


def _forget(spark: SparkSession, path: str, epoch: int) -> None:
    """Remove what no restart can ask for: epochs before the last but one."""
    files, jpath = _fs(spark, f"{path}/{epoch - 2}")
    files.delete(jpath, True)


def follow_stream(turns: DataFrame, path: str, checkpoint: str, late_s: float = C.TTL_S, half_life_s: float = C.HALF_LIFE_S, ttl_s: float = C.TTL_S) -> StreamingQuery:
    """Follow conversations (key, ts, ord, score, verdict, labels and, if it is there, similarity) by the fold of the batch operator.

    Each micro-batch folds its turns, in order of event time, from the records that the last one left, and
    writes the steps (key, ts, ord, turn, risk, state, verdict, floored) to `path`/steps/epoch and the
    records to `path`/records/epoch. Expiry goes by event time, so a replay gives what the batch gives. A
    record is dropped once the newest turn is its time to live and `late_s` ahead. An epoch that runs again
    overwrites what it wrote.
    """
    schema = StructType.fromDDL(f"key {turns.schema['key'].dataType.simpleString()}, record {C.RECORD}")

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        similarity = F.col("similarity") if "similarity" in batch.columns else None
        turn = C.turn_column(F.col("ts"), F.col("ord"), F.col("score"), F.col("verdict"), F.col("labels"), similarity)
        own = batch.where("key IS NOT NULL AND ts IS NOT NULL").groupBy("key").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        held = _before(spark, f"{path}/records", epoch, schema)
        both = own.withColumn("record", F.lit(None).cast(C.RECORD)) if held is None else own.join(held, "key", "full")
        moved = both.select("key", F.when(F.col("turns").isNull(), F.col("record")).otherwise(C.folded(F.col("turns"), F.coalesce("record", C.fresh_record()), half_life_s, ttl_s)).alias("record"), F.col("turns").isNotNull().alias("new"))
        moved = materialise(moved, "folded")
        steps = moved.where("new").select("key", F.explode("record.out").alias("o")).select("key", "o.*")
        steps.write.mode("overwrite").parquet(f"{path}/steps/{epoch}")
        newest = moved.agg(F.max("record.last")).first()[0] or 0.0
        kept = moved.where(F.col("record.last") > newest - ttl_s - late_s).select("key", F.col("record").withField("out", F.array().cast(moved.schema["record"].dataType["out"].dataType)).alias("record"))
        kept.write.mode("overwrite").parquet(f"{path}/records/{epoch}")
        release(moved)
        _forget(spark, f"{path}/records", epoch)

    return turns.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ChunkScanner:
    """Holds back the end of a growing text so that nothing recognised is released in part."""

    def __init__(self, find, window: int = 200, canary: str | None = None, tail: str = "", halted: bool = False):
        if canary and window < len(canary):
            raise ValueError("the window must hold the canary")
        self.find, self.window, self.canary, self.tail, self.halted = find, window, canary, tail, halted

    def feed(self, chunk: str, last: bool = False) -> str:
        """The text that may be released after this chunk."""
        if self.halted:
            return ""
        text = self.tail + chunk
        if self.canary and self.canary in text:
            self.halted, self.tail = True, ""
            return ""
        boundary = len(text) if last else max(0, len(text) - self.window)
        spans = sorted(self.find(text))
        moved = True
        while moved and not last:
            inside = [s for s, e, _ in spans if s < boundary < e]
            moved = bool(inside)
            boundary = min(inside, default=boundary)
        out, at = [], 0
        for s, e, rule in spans:
            if e <= boundary and s >= at:
                out += [text[at:s], f"[REDACTED:{rule}]"]
                at = e
        out.append(text[at:boundary])
        self.tail = text[boundary:]
        return "".join(out)


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """Spans of credentials and exfiltration shapes in one text."""
    import math
    import re
    from collections import Counter

    from quernstone.operators import egress as E

    bits = lambda s: -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())
    out = [(*m.span(), rule) for rule, p in E.SECRETS for m in re.finditer(p, text)]
    out += [(*m.span(), "high-entropy") for m in re.finditer(E.OPAQUE, text) if bits(m.group()) >= E.OPAQUE_ENTROPY]
    for m in re.finditer(E.IMAGE, text):
        if any(len(v) >= E.VALUE_LENGTH and bits(v) >= E.VALUE_ENTROPY for v in re.findall(E.QUERY_VALUE, m.group(1))):
            out.append((*m.span(), "markdown-image-exfil"))
    return out + [(*m.span(), "fabricated-tool-call") for m in re.finditer(E.TOOL_CALL, text)]


def _scan(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tail, halted = state.get if state.exists else ("", False)
    scanner = None
    out = []
    for c in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
        scanner = scanner or ChunkScanner(find_secrets, 200, c["canary"] or None, tail, halted)
        released = scanner.feed(c["chunk"] or "", bool(c["is_last"]))
        out.append((key[0], c["seq"], released, scanner.halted))
        if c["is_last"]:
            state.remove()
            scanner = None
            tail, halted = "", False
    if scanner:
        state.update((scanner.tail, scanner.halted))
    yield pd.DataFrame(out, columns=["response_id", "seq", "released", "halted"])


def scan_stream(chunks: DataFrame) -> DataFrame:
    """(response_id, seq, released, halted) for chunks (response_id, seq, chunk, is_last, canary)."""
    return chunks.groupBy("response_id").applyInPandasWithState(_scan, "response_id string, seq long, released string, halted boolean", "tail string, halted boolean", "append", GroupStateTimeout.NoTimeout)


def keep_recent(decisions: DataFrame, path: str, checkpoint: str, most: int = 500) -> StreamingQuery:
    """Keep the newest decisions in a Parquet table under `path`, one folder a batch."""

    def merge(batch: DataFrame, epoch: int) -> None:
        held = _before(batch.sparkSession, path, epoch, batch.schema)
        both = batch.unionByName(held) if held is not None else batch
        both.dropDuplicates(["id"]).orderBy(F.desc("ts"), F.desc("id")).limit(most).write.mode("overwrite").parquet(f"{path}/{epoch}")
        _forget(batch.sparkSession, path, epoch)

    return decisions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_feed(held: DataFrame, decisions: DataFrame, path: str, checkpoint: str, first: int = 20) -> StreamingQuery:
    """A feed of decisions under `path`: the newest of those held, oldest first, as epoch=-1, then each batch of new ones as it comes.

    Decisions that were held already do not come again.
    """
    recent = held.orderBy(F.desc("ts"), F.desc("id")).limit(first).orderBy("ts", "id")
    recent.coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch=-1")
    columns = held.columns

    def tail(batch: DataFrame, epoch: int) -> None:
        begun = batch.sparkSession.read.schema(held.schema).parquet(f"{path}/epoch=-1")
        batch.select(columns).dropDuplicates(["id"]).join(begun.select("id"), "id", "left_anti").select(columns).sortWithinPartitions("ts", "id").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return decisions.writeStream.foreachBatch(tail).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdict_counts(decisions: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Verdicts by tumbling windows of event time; later rows than `late` are dropped. An extension."""
    at = F.col("ts").cast("timestamp")
    return decisions.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", width), F.lower("verdict").alias("verdict")).count()
