"""Count and bit tables over all rows, with as many slots as the data ask for up to a stated bound.

Every task adds its rows into one array and sends the blocks of it that are not empty. Input partitions
are joined into at most TASKS_A_CORE tasks a core, so what is sent grows with the cluster and not with the
input. Blocks are summed in 64 bits by as many tasks as there are cores, and only the finished table, a
byte or a bit a slot, reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans.runtime import materialise, release

BLOCK = 1 << 16
TASKS_A_CORE = 2
#: A task sends its counts before one of them could pass 32 bits.
MOST_ADDED = 1 << 31
#: Steps of a byte code for each doubling of a count: 255 stands for 2**63.5.
STEPS = 4


def table_bits(expected: float, least: int, most: int) -> int:
    """log2 of the slots for so many entries, within the bounds."""
    return min(most, max(least, math.ceil(math.log2(max(expected, 1)))))


def _send(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    blocks = counts.reshape(-1, min(BLOCK, len(counts)))
    full = np.flatnonzero(blocks.any(axis=1))
    for part in np.array_split(full, max(1, len(full) // 16)):
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([blocks[i].tobytes() for i in part], pa.binary())], ["block", "counts"])


def _gathered(df: DataFrame, add: Callable, merge: Callable, size: int) -> np.ndarray:
    """The merged table of so many bytes."""
    cores, blocks = df.sparkSession.sparkContext.defaultParallelism, max(1, size // BLOCK)
    schema = "block int, counts binary"
    merged = materialise(df.coalesce(TASKS_A_CORE * cores).mapInArrow(add, schema).repartition(min(blocks, cores), F.col("block")).mapInArrow(merge, schema), "table")
    table = np.zeros((blocks, size // blocks), np.uint8)
    for row in merged.toLocalIterator():
        table[row.block] = np.frombuffer(row.counts, np.uint8)
    release(merged)
    return table.reshape(-1)


def slot_codes(df: DataFrame, slots: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """How often each slot occurs over all rows, as log_codes; `slots` gives the slots of a batch."""
    size = 1 << bits

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, added = np.zeros(size, np.uint32), 0
        for batch in batches:
            for some in slots(batch):
                if added + len(some) > MOST_ADDED:
                    yield from _send(counts)
                    counts[:] = 0
                    added = 0
                np.add.at(counts, some, np.uint32(1))
                added += len(some)
        yield from _send(counts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(counts, np.uint32)
                if block in sums:
                    sums[block] += counts
                else:
                    sums[block] = counts.astype(np.uint64)
        for block, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([log_codes(counts).tobytes()], pa.binary())], ["block", "counts"])

    return _gathered(df, add, merge, size)


def bit_table(df: DataFrame, slots: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """Packed bits (little end first) of the slots that occur, 2**bits of them."""
    size = 1 << (bits - 3)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << bits, bool)
        for batch in batches:
            marks[slots(batch)] = True
        yield from _send(np.packbits(marks, bitorder="little"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(part, np.uint8)
                held[block] = held[block] | part if block in held else part
        for block, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])

    return _gathered(df, add, merge, size)


def shipped(spark: SparkSession, table: np.ndarray) -> Broadcast:
    """A table sent to all workers, compressed; `received` is the other end."""
    return spark.sparkContext.broadcast((len(table), pa.compress(table.tobytes(), "zstd", asbytes=True)))


@lru_cache(maxsize=2)
def _expanded(size: int, data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), np.uint8)


def received(table: Broadcast) -> np.ndarray:
    return _expanded(*table.value)


def log_codes(counts: np.ndarray) -> np.ndarray:
    """64-bit counts as bytes that rise with them: 0 for 0, 1 for 1, then STEPS for each doubling."""
    steps = np.round(STEPS * np.log2(np.maximum(counts, 1).astype(np.float64))).astype(np.int64) + (counts > 0)
    return np.minimum(255, steps).astype(np.uint8)


def code_values() -> np.ndarray:
    """The count that each byte of log_codes stands for."""
    values = 2.0 ** ((np.arange(256) - 1) / STEPS)
    values[0] = 0
    return values


#: An id sieve has eight bits for each id, from 8 KB to 8 MB; with more ids than bits it would let all pass.
LEAST_ID_BITS, MOST_ID_BITS = 16, 26


def id_bits(ids: int) -> int | None:
    """log2 of the bits of a sieve for so many ids; None where a sieve of the largest size is of no use."""
    return table_bits(8 * ids, LEAST_ID_BITS, MOST_ID_BITS) if ids <= 1 << MOST_ID_BITS else None


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit table that holds at least the given ids; a first sieve before an exact semi-join."""
    return bit_table(ids.select(id_slot(ids.columns[0], bits)), lambda batch: batch.column("slot").to_numpy(), bits)


def id_slot(column: str, bits: int) -> Column:
    """The slot of an id in id_filter's table."""
    return F.xxhash64(column).bitwiseAND((1 << bits) - 1).cast("int").alias("slot")
