"""Problem 3: the same or nearly the same records in the training and the evaluation splits.

Minwise hashes of the word pairs of each record are cut into bands; records meet in a bucket when a
whole band agrees, and only pairs of a training with an evaluation record become candidates. A bit map
of 256 bits per set bounds their overlap from above, which ends most candidates that share no more than
an opening; the exact similarity of the others is computed over whole texts. With 114 bands of 4 rows a
pair at similarity 0.5 is missed with a chance of (1 - 1/16)**114 = 0.06 %, less above.

The bands are dealt in rounds, each with its own pass over the texts, so that only a third of the
bucket entries is on disk at once. An entry is ten bytes: the bucket and the print of a set, packed by
the task and stretch of buckets it belongs to. A task reads its stretches in order and holds one at a
time. A bucket that would give very many pairs leaves its task in chunks, which then meet chunk by chunk
all over the cluster.

Records with equal sets are one representative during the search, with a mark for the sides it stands
on; they are expanded at the end, since every pair of rows is asked for. The report counts them by
their numbers, without expanding.

Null, empty and one-word texts, rows without a split and rows of other splits are in no pair. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.kernels import mix
from quernstone.llm.jaccard import sets_of, verified
from quernstone.operators.similarity import MAP_COLUMNS, MAP_WORDS, bit_maps, may_overlap
from quernstone.plans.runtime import materialise, release, text_slices

BANDS, ROWS, ROUNDS = 114, 4, 3
#: Entries of a stretch of buckets, and tasks of a round; more entries make more stretches a task.
STRETCH_ENTRIES = 2_000_000
MOST_TASKS = 20_000
#: Pairs of a bucket from which it leaves its task in chunks, the entries of a chunk, and pairs made at once.
HOT_PAIRS = 20_000_000
CHUNK_ENTRIES = 4_096
PAIRS_AT_ONCE = 2_000_000
#: Prints a task remembers so as to write the bands of a set once.
REMEMBERED = 200_000
PRINT = (1 << 40) - 1


def minwise_bands(values: np.ndarray, starts: np.ndarray, which: range = range(BANDS), rows: int = ROWS) -> np.ndarray:
    """One hash per set and band of its minwise hashes, for the bands asked for; sets must not be empty."""
    out = np.zeros((len(which), len(starts) - 1), np.uint64)
    for i, band in enumerate(which):
        for k in range(band * rows, band * rows + rows):
            least = np.minimum.reduceat((values ^ np.uint64(0xD1B54A32D192ED03 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xAEF17502108EF2D9 + 2 * k), starts[:-1])
            out[i] = mix(out[i] + least + np.uint64(band))
    return out.T


def _prints(words: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                values, offsets = sets_of(batch.column("text").to_pylist(), words)
                kept = np.flatnonzero(np.diff(offsets) > 0)
                if not len(kept):
                    continue
                n = np.diff(offsets)[kept]
                starts = np.concatenate([[0], np.cumsum(n)])
                prints = [np.add.reduceat(mix(values + np.uint64(s)), starts[:-1]).view(np.int64) for s in (17, 71)]
                take = pa.array(kept)
                maps = bit_maps(values, starts)
                spare = (n - np.bitwise_count(maps.view(np.uint64)).sum(axis=1)).astype(np.int32)
                columns = [batch.column("id").take(take), batch.column("side").take(take), pa.array(n.astype(np.int32)), *map(pa.array, prints), pa.array(spare), *(pa.array(maps[:, k].copy()) for k in range(MAP_WORDS))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "side", "n", "f1", "f2", "spare", *MAP_COLUMNS])

    return run


def _packed(key: np.ndarray, own: np.ndarray) -> bytes:
    """Ten bytes for each entry: the low five of the bucket and those of the print."""
    packed = np.empty((len(key), 10), np.uint8)
    packed[:, :5] = key.view(np.uint8).reshape(-1, 8)[:, :5]
    packed[:, 5:] = own.view(np.uint8).reshape(-1, 8)[:, :5]
    return packed.tobytes()


def _entries(words: str, which: range, tasks: int, stretches: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (task, stretch, side, entries): the bands of the sets, those of a repeated set once where a task still knows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {1: [], 2: []}
            for batch in text_slices(whole, "text"):
                values, offsets = sets_of(batch.column("text").to_pylist(), words)
                kept = np.flatnonzero(np.diff(offsets) > 0)
                if not len(kept):
                    continue
                starts = np.concatenate([[0], np.cumsum(np.diff(offsets)[kept])])
                own = np.add.reduceat(mix(values + np.uint64(17)), starts[:-1]) & np.uint64(PRINT)
                side = batch.column("side").to_numpy()[kept]
                fresh = np.zeros(len(kept), bool)
                for i, mark in enumerate((own << np.uint64(2) | side.astype(np.uint64)).tolist()):
                    if mark not in seen:
                        seen.add(mark)
                        fresh[i] = True
                if len(seen) > REMEMBERED:
                    seen.clear()
                if not fresh.any():
                    continue
                n = np.diff(starts)
                bands = minwise_bands(values[np.repeat(fresh, n)], np.concatenate([[0], np.cumsum(n[fresh])]), which)
                for s in (1, 2):
                    mine = side[fresh] == s
                    held[s].append((bands[mine].reshape(-1), np.repeat(own[fresh][mine], len(which))))
            for s, parts in held.items():
                if not parts:
                    continue
                key, own = np.concatenate([k for k, _ in parts]), np.concatenate([p for _, p in parts])
                if not len(key):
                    continue
                order = np.argsort(key)
                key, own = key[order], own[order]
                cell = ((key >> np.uint64(32)) * np.uint64(tasks * stretches) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
                begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
                packed = _packed(key, own)
                blobs = pa.array([packed[10 * a : 10 * b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
                where = cell[begin]
                yield pa.RecordBatch.from_arrays([pa.array((where // stretches).astype(np.int32)), pa.array((where % stretches).astype(np.int32)), pa.array(np.full(len(where), s, np.int8)), blobs], ["task", "stretch", "side", "entries"])

    return run


def _pairs_of(left: np.ndarray, right: np.ndarray, some: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (left, right) pairs: right[i] with some[i] entries of left from begin[i] on, so many at once."""
    sums = np.concatenate([[0], np.cumsum(some)])
    at = 0
    while at < len(right):
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + PAIRS_AT_ONCE, "right")) - 1)
        part = some[at:end]
        x = left[np.arange(int(part.sum())) - np.repeat(sums[at:end] - sums[at], part) + np.repeat(begin[at:end], part)]
        y = np.repeat(right[at:end], part)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        fresh = np.ones(len(x), bool)
        fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        yield x[fresh], y[fresh]
        at = end


_NONE = {"x": pa.int64(), "y": pa.int64(), "bucket": pa.int64(), "side": pa.int32(), "chunk": pa.binary()}


def _row(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kind)) for c, kind in _NONE.items()], list(_NONE))


def _chunks(bucket: int, side: int, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(prints), CHUNK_ENTRIES):
        yield _row(bucket=pa.array([bucket], pa.int64()), side=pa.array([side], pa.int32()), chunk=pa.array([prints[k : k + CHUNK_ENTRIES].tobytes()], pa.binary()))


class _Stretch:
    """The entries of one stretch of buckets."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, bytes]] = []
        self.held = 0
        self.hot = np.zeros(0, np.uint64)

    def add(self, side: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        self.parts.append((side, blob))
        self.held += len(blob) // 10
        if self.held > 4 * STRETCH_ENTRIES:
            # only buckets far above the others make a stretch so long: their entries leave at once
            key, own, sides = self._unpacked()
            found, n = np.unique(key, return_counts=True)
            self.hot = np.union1d(self.hot, found[n > STRETCH_ENTRIES // 8])
            yield from self._leave(key, own, sides)
            stay = ~np.isin(key, self.hot)
            self.parts = [(s, _packed(key[stay & (sides == s)], own[stay & (sides == s)])) for s in (1, 2)]
            self.held = int(stay.sum()) // 2

    def _unpacked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(b for _, b in self.parts), np.uint8).reshape(-1, 10)
        wide = np.zeros((2, len(raw), 8), np.uint8)
        wide[0, :, :5], wide[1, :, :5] = raw[:, :5], raw[:, 5:]
        sides = np.repeat(np.array([s for s, _ in self.parts], np.int8), [len(b) // 10 for _, b in self.parts])
        return wide[0].view(np.uint64).reshape(-1), wide[1].view(np.uint64).reshape(-1), sides

    def _leave(self, key: np.ndarray, own: np.ndarray, sides: np.ndarray) -> Iterator[pa.RecordBatch]:
        for bucket in self.hot:
            for side in (1, 2):
                yield from _chunks(int(bucket), side, own[(key == bucket) & (sides == side)].view(np.int64))

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        key, own, sides = self._unpacked()
        order = np.lexsort((sides, key))
        key, own, sides = key[order], own[order], sides[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        right = np.add.reduceat((sides == 2).astype(np.int64), begin)
        left = size - right
        hot = np.isin(key[begin], self.hot) | (left * right > HOT_PAIRS)
        self.hot = key[begin[hot]]
        yield from self._leave(key, own, sides)
        good = np.flatnonzero((left > 0) & (right > 0) & ~hot)
        at = np.concatenate([np.arange(b + n, b + n + m) for b, n, m in zip(begin[good], left[good], right[good])]) if len(good) else np.zeros(0, np.int64)
        ids = own.view(np.int64)
        for x, y in _pairs_of(ids, ids[at], np.repeat(left[good], right[good]), np.repeat(begin[good], right[good])):
            yield _row(x=pa.array(x), y=pa.array(y))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, at = _Stretch(), None
    for batch in batches:
        for stretch, side, blob in zip(batch.column("stretch").to_pylist(), batch.column("side").to_pylist(), batch.column("entries").to_pylist()):
            if stretch != at:
                yield from now.close()
                now, at = _Stretch(), stretch
            yield from now.add(side, blob)
    yield from now.close()


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two chunks of a hot bucket."""
    for batch in batches:
        for a, b in zip(batch.column("l").to_pylist(), batch.column("r").to_pylist()):
            left, right = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            for x, y in _pairs_of(left, right, np.full(len(right), len(left)), np.zeros(len(right), np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])


def bucket_pairs(texts: DataFrame, rows: int, words: str) -> DataFrame:
    """(x, y): prints of a training and an evaluation set that share a bucket, of texts (text, side)."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    a_round = BANDS // ROUNDS
    tasks = min(MOST_TASKS, max(2 * cores, math.ceil(rows * a_round / STRETCH_ENTRIES)))
    stretches = max(1, math.ceil(rows * a_round / STRETCH_ENTRIES / tasks))
    found = []
    for k in range(ROUNDS):
        entries = texts.select("text", "side").mapInArrow(_entries(words, range(k * a_round, (k + 1) * a_round), tasks, stretches), "task int, stretch int, side tinyint, entries binary")
        placed = entries.repartitionById(tasks, F.col("task")).drop("task").sortWithinPartitions("stretch")
        met = materialise(placed.mapInArrow(_met, "x bigint, y bigint, bucket bigint, side int, chunk binary"), f"met{k}")
        found.append(met.where("chunk IS NULL").select("x", "y"))
        hot = met.where("chunk IS NOT NULL")
        if not hot.isEmpty():
            left, right = (hot.where(f"side = {s}").select("bucket", F.col("chunk").alias(c)) for s, c in ((1, "l"), (2, "r")))
            cells = left.join(right, "bucket").select("l", "r").repartition(8 * cores)
            found.append(materialise(cells.mapInArrow(_crossed, "x bigint, y bigint").distinct(), "crossed"))
    pairs = found[0]
    for other in found[1:]:
        pairs = pairs.union(other)
    return pairs.distinct()


def _matched(rows: DataFrame, id_col: str, text_col: str, split_col: str, threshold: float, words: str) -> tuple[DataFrame, DataFrame]:
    """(t_head, e_head) of the representatives that are that similar, and the members (id, side, head) they stand for."""
    side = F.when(F.col(split_col) == "train", 1).when(F.col(split_col).isin("validation", "test"), 2)
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), side.alias("side")).where("id IS NOT NULL AND text IS NOT NULL AND side IS NOT NULL")
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, side int, n int, f1 bigint, f2 bigint, spare int, " + ", ".join(f"{m} bigint" for m in MAP_COLUMNS)
    prints = materialise(texts.mapInArrow(_prints(words), schema), "prints")
    key = ["n", "f1", "f2"]
    same = [F.min(c).alias(c) for c in ("spare", *MAP_COLUMNS)]
    heads = prints.groupBy(*key).agg(F.min("id").alias("head"), F.bit_or("side").alias("sides"), *same)
    heads = materialise(heads.withColumn("print", F.col("f1").bitwiseAND(F.lit(PRINT))), "heads")
    met = materialise(bucket_pairs(texts, prints.count(), words), "pairs")
    maps = heads.select("print", F.col("head").alias("id"), "sides", "n", "spare", *MAP_COLUMNS)
    x, y = maps.where("(sides & 1) > 0").alias("x"), maps.where("(sides & 2) > 0").alias("y")
    hopeful = met.alias("p").join(x, F.col("p.x") == F.col("x.print")).join(y, F.col("p.y") == F.col("y.print")).where(may_overlap(threshold) & (F.col("x.id") != F.col("y.id")))
    hopeful = materialise(hopeful.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "hopeful")
    release(met)
    close = verified(hopeful, texts.select("id", "text"), words, threshold, "close").select("a", "b")
    release(hopeful)
    alone = heads.where("sides = 3").select(F.col("head").alias("t_head"), F.col("head").alias("e_head"))
    both = close.select(F.col("a").alias("t_head"), F.col("b").alias("e_head")).union(close.select("b", "a")).union(alone)
    members = prints.join(heads.select(*key, "head"), key).select("id", "side", "head")
    wanted = both.select(F.col("t_head").alias("head")).distinct()
    members = materialise(members.join(wanted, "head", "left_semi").distinct(), "members")
    return both, members


def split_overlaps(rows: DataFrame, id_col: str = "id", text_col: str = "text", split_col: str = "source_split", threshold: float = 0.5, words: str = "alnum") -> DataFrame:
    """(id_a, id_b), id_a < id_b: each pair of a training row with a validation or test row that is that similar."""
    both, members = _matched(rows, id_col, text_col, split_col, threshold, words)
    pairs = both.join(members.where("side = 1").select(F.col("head").alias("t_head"), F.col("id").alias("t")), "t_head")
    pairs = pairs.join(members.where("side = 2").select(F.col("head").alias("e_head"), F.col("id").alias("e")), "e_head").where("t <> e")
    return pairs.select(F.least("t", "e").alias("id_a"), F.greatest("t", "e").alias("id_b")).distinct()


def overlap_report(rows: DataFrame, id_col: str = "id", text_col: str = "text", split_col: str = "source_split", source_col: str = "source", threshold: float = 0.5, words: str = "alnum") -> DataFrame:
    """(split, source, pairs, rows) of the evaluation rows that repeat training rows; the numbers come from classes of equal sets."""
    both, members = _matched(rows, id_col, text_col, split_col, threshold, words)
    trained = members.where("side = 1").groupBy(F.col("head").alias("t_head")).agg(F.count("*").alias("n"))
    partners = both.join(trained, "t_head").groupBy(F.col("e_head").alias("head")).agg(F.sum("n").alias("pairs"))
    each = members.where("side = 2").join(partners, "head").select("id", "pairs")
    held = rows.where(F.col(split_col).isin("validation", "test")).select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), F.col(source_col).alias("source"))
    return each.join(held, "id").groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("rows"))
