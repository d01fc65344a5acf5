"""Problem 4: groups of records that share most of their content.

Adaptive multi-match prefixes. The word pairs of a document are put in one global order, rarest
first, by a count table over the whole corpus whose size follows the corpus up to 64 MB. If two sets overlap enough, their
prefixes of length n - ceil(t n) + l share at least l members, for every l. Each document picks its own
l where the estimated cost of scanning the posting lists of the longer prefix plus checking the
candidates left is least; two documents become a candidate once they share as many prefix members
as the smaller l of both asks. Of the two, the one with the smaller set only needs the shorter prefix
n - ceil(2t/(1+t) n) + l.

Postings meet in tasks by member, each document with those of its prefix members that belong to the
task and a bit map of its whole set. The map bounds the overlap from above without loss, so that
hopeless pairs end where they arise instead of being shuffled. A member of very many documents is cut
into a grid of document blocks of its own, as fine as the member is frequent: documents of one block meet
in a cell of the diagonal, those of two blocks in one cell beside it, so a pair meets once and no cell
holds more than about HOT documents on either side.

Groups of copies cannot flood a list: documents with equal sets are one representative from the
start, and a first pass links documents to a leader that shares three drawn members of its prefix. The
exhaustive pass then only pairs documents of different groups, which loses no link between groups.

Null, empty and one-word texts are in no group. Any id type that orders is accepted; a repeated id
counts once. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.kernels import mix
from quernstone.functions.sketch import code_values, received, shipped, slot_codes, table_bits
from quernstone.llm.components import connected_groups
from quernstone.llm.jaccard import sets_of, verified
from quernstone.operators.similarity import enough
from quernstone.plans.runtime import materialise, release, text_slices

#: Bounds of the table that orders word pairs (log2 of its bytes) and the characters a word pair takes up,
#: the largest l, and what checking a candidate costs in scanned postings; each further match is taken to
#: leave a quarter of the candidates.
LEAST_BITS, MOST_BITS = 18, 26
PAIR_CHARS = 6
MOST_MATCHES = 8
CHECK_COST = 40.0
SURVIVING = 0.25
#: Postings of a task, and the documents of a member from which they are cut into blocks of so many.
TASK_POSTINGS = 800_000
HOT = 20_000
#: Keys that lead to a leader, and the members of the prefix that each of them is made of.
KEYS, KEY_MEMBERS = 6, 3
#: Pairs made at once, and candidates a task holds before it sends them.
CHUNK = 1_500_000
HELD_PAIRS = 6_000_000
#: Low bits of a posting: inside the short prefix, second block of a cell, cell of two blocks.
NEAR, SIDE, CROSS = 1, 2, 4


def slot_of(values: np.ndarray, bits: int) -> np.ndarray:
    """The slot of a word pair: its high bits, which a posting keeps."""
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def _slots(words: str, bits: int) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    def run(whole: pa.RecordBatch) -> Iterator[np.ndarray]:
        for batch in text_slices(whole, "text"):
            values, _ = sets_of(batch.column("text").to_pylist(), words)
            yield slot_of(values, bits)

    return run


def prefix_lengths(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Shortest prefixes (l = 1) of sets with n members: against smaller sets, and against larger ones."""
    long = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    short = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1
    return long, short


def choose_matches(row: np.ndarray, position: np.ndarray, frequency: np.ndarray, n: np.ndarray, starts: np.ndarray, threshold: float) -> np.ndarray:
    """The l of each set: least scanning plus checking cost, where scanning grows and checking shrinks with l."""
    long, _ = prefix_lengths(n, threshold)
    scanned = np.concatenate([[0.0], np.cumsum(np.maximum(frequency - 1, 0))])
    most = np.minimum(MOST_MATCHES, np.maximum(1, np.ceil(threshold * n - 1e-9).astype(np.int64)))
    best, chosen = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for matches in range(1, MOST_MATCHES + 1):
        end = starts[:-1] + np.minimum(n, long + matches - 1)
        lists = scanned[end] - scanned[starts[:-1]]
        cost = lists * (1 + CHECK_COST * SURVIVING ** (matches - 1))
        better = (cost < best) & (matches <= most)
        best[better], chosen[better] = cost[better], matches
    return chosen


def _bitmaps(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """For each set a bit map of at least twice as many bits as members (a power of two, 64 at least)."""
    n = np.diff(starts)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1)))).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(bits)])
    marks = np.zeros(offsets[-1], np.uint8)
    where = (values >> np.uint64(40)).astype(np.int64) & np.repeat(bits - 1, n)
    marks[np.repeat(offsets[:-1], n) + where] = 1
    packed = np.packbits(marks, bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip(offsets[:-1] // 8, offsets[1:] // 8)]


def _leading(members: np.ndarray, counts: np.ndarray) -> pa.Array:
    """For each document with a prefix KEYS hashes of KEY_MEMBERS of its members, each the least under a hash function of its own."""
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    keys = np.zeros((KEYS, int(some.sum())), np.uint64)
    if len(members):
        for k in range(KEYS * KEY_MEMBERS):
            salted = mix(members ^ np.uint64(0x51ED270B * (k + 1)))
            keys[k // KEY_MEMBERS] = mix(keys[k // KEY_MEMBERS] * np.uint64(31) + np.minimum.reduceat(salted, starts) + np.uint64(k))
    ends = np.concatenate([[0], np.cumsum(some * KEYS)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.T.reshape(-1).view(np.int64)))


def _profiles(words: str, threshold: float, codes: object, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, amounts = received(codes), code_values()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                values, offsets = sets_of(batch.column("text").to_pylist(), words)
                kept = np.flatnonzero(np.diff(offsets) > 0)
                if not len(kept):
                    continue
                n = np.diff(offsets)[kept]
                starts = np.concatenate([[0], np.cumsum(n)])
                row = np.repeat(np.arange(len(kept)), n)
                prints = [np.add.reduceat(mix(values + np.uint64(s)), starts[:-1]).view(np.int64) for s in (17, 71)]
                bitmaps = _bitmaps(values, starts)
                code = table[slot_of(values, bits)]
                order = np.argsort((row << 8) | code, kind="stable")
                values, code = values[order], code[order]
                position = np.arange(len(row)) - starts[row]
                matches = choose_matches(row, position, amounts[code], n, starts, threshold)
                long, short = prefix_lengths(n, threshold)
                inside = (position < (long + matches - 1)[row]) & (code > 1)
                near = position < (short + matches - 1)[row]
                plain = (values & ~np.uint64(NEAR | SIDE | CROSS))[inside]
                member = plain | np.where(near[inside], np.uint64(NEAR), np.uint64(0))
                counts = np.bincount(row[inside], minlength=len(kept))
                lists = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(kept)),
                        pa.array(n.astype(np.int32)),
                        *map(pa.array, prints),
                        pa.array(matches.astype(np.int32)),
                        pa.array(bitmaps, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(member.view(np.int64))),
                        _leading(plain, counts),
                    ],
                    ["id", "n", "f1", "f2", "matches", "bitmap", "members", "leading"],
                )

    return run


def cells_of(member: np.ndarray, spread: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells in which hot postings meet, as (which posting, member of the cell): the block's own and one with each other block."""
    own = (mix(spread) % blocks.astype(np.uint64)).astype(np.int64)
    which = np.repeat(np.arange(len(member)), blocks)
    other = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = own[which]
    cell = (np.minimum(own, other) * blocks[which] + np.maximum(own, other) + 1).astype(np.uint64)
    base = member[which] & ~np.uint64(NEAR | SIDE | CROSS)
    fresh = mix(base + mix(cell)) & ~np.uint64(NEAR | SIDE | CROSS)
    flags = (member[which] & np.uint64(NEAR)) | np.where(own > other, np.uint64(SIDE), np.uint64(0)) | np.where(own != other, np.uint64(CROSS), np.uint64(0))
    return which, fresh | flags


def _routes(tasks: int, codes: object, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per document and task, with the document's members that meet there; hot members go to a row and column of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_of = np.ceil(code_values() / HOT).astype(np.int64)
        table = received(codes)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = batch.column("members")
                row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
                flat = lists.flatten().to_numpy().view(np.uint64)
                blocks = blocks_of[table[slot_of(flat, bits)]]
                hot = blocks > 1
                if hot.any():
                    which, cells = cells_of(flat[hot], batch.column("spread").to_numpy().view(np.uint64)[row[hot]], blocks[hot])
                    row, flat = np.concatenate([row[~hot], row[hot][which]]), np.concatenate([flat[~hot], cells])
                task = (mix(flat & ~np.uint64(NEAR | SIDE)) % np.uint64(tasks)).astype(np.int64)
                order = np.lexsort((task, row))
                row, flat, task = row[order], flat[order], task[order]
                first = np.ones(len(row), bool)
                first[1:] = (row[1:] != row[:-1]) | (task[1:] != task[:-1])
                first = np.flatnonzero(first)
                if not len(first):
                    continue
                ends = np.append(first, len(row)).astype(np.int32)
                take = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(task[first].astype(np.int32)),
                        *(batch.column(c).take(take) for c in ("id", "part", "shape", "bitmap")),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                    ],
                    ["task", "id", "part", "shape", "bitmap", "members"],
                )

    return run


class _Maps:
    """Bit maps by size class, each also folded to the next smaller class."""

    def __init__(self, maps: list[bytes], n: np.ndarray):
        length = np.array([len(m) for m in maps])
        self.kind = np.log2(length // 8).astype(np.int64)
        self.place = np.zeros(len(maps), np.int64)
        self.full, self.half = {}, {}
        self.spare = {}
        for kind in np.unique(self.kind):
            own = np.flatnonzero(self.kind == kind)
            self.place[own] = np.arange(len(own))
            words = np.frombuffer(b"".join(maps[i] for i in own), np.uint64).reshape(len(own), -1)
            self.full[kind] = words, n[own] - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
            if words.shape[1] > 1:
                half = words[:, : words.shape[1] // 2] | words[:, words.shape[1] // 2 :]
                self.half[kind] = half, n[own] - np.bitwise_count(half).sum(axis=1, dtype=np.int64)

    def bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """At most so many members are shared by the sets x[i] and y[i]."""
        out = np.zeros(len(x), np.int64)
        kx, ky = self.kind[x], self.kind[y]
        for key in np.unique(kx * 64 + ky):
            a, b = divmod(int(key), 64)
            at = np.flatnonzero((kx == a) & (ky == b))
            if abs(a - b) > 1:
                continue  # one set has over twice the members of the other
            left = self.full[a] if a <= b else self.half[a]
            right = self.full[b] if b <= a else self.half[b]
            step = max(1, 4_000_000 // left[0].shape[1])
            for k in range(0, len(at), step):
                i, j = self.place[x[at[k : k + step]]], self.place[y[at[k : k + step]]]
                shared = np.bitwise_count(left[0][i] & right[0][j]).sum(axis=1, dtype=np.int64)
                out[at[k : k + step]] = shared + np.minimum(left[1][i], right[1][j])
        return out


def _meet(threshold: float, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t.column("id").combine_chunks()
        n, matches = np.divmod(t.column("shape").to_numpy(), MOST_MATCHES + 1)
        part = t.column("part").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        order_id = np.empty(len(ids), np.int64)
        order_id[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        lists = t.column("members").combine_chunks()
        row = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(lists).to_numpy())
        flat = lists.flatten().to_numpy().view(np.uint64)
        maps = _Maps(t.column("bitmap").to_pylist(), n)
        del t, held
        # beside the diagonal only documents of different blocks meet, elsewhere those of different groups
        side = np.where(flat & np.uint64(CROSS) > 0, (flat & np.uint64(SIDE)).astype(np.int64), part[row])
        order = np.lexsort((side, flat & ~np.uint64(NEAR | SIDE)))
        row, flat, side = row[order], flat[order], side[order]
        member, near = flat & ~np.uint64(NEAR | SIDE), (flat & np.uint64(NEAR)).astype(bool)
        index = np.arange(len(row))
        new_member = np.ones(len(row), bool)
        new_member[1:] = member[1:] != member[:-1]
        new_side = new_member.copy()
        new_side[1:] |= side[1:] != side[:-1]
        list_start = np.maximum.accumulate(np.where(new_member, index, 0))
        partners = np.maximum.accumulate(np.where(new_side, index, 0)) - list_start
        sums = np.concatenate([[0], np.cumsum(partners)])

        def sent(keys: list[np.ndarray], hits: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys, where = np.unique(np.concatenate(keys), return_inverse=True)
            hits = np.bincount(where, np.concatenate(hits)).astype(np.int32)
            a, b = keys // len(n), keys % len(n)
            for k in range(0, len(keys), 50_000):
                s = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(a[s])), ids.take(pa.array(b[s])), pa.array(hits[s]), pa.array(np.minimum(matches[a[s]], matches[b[s]]).astype(np.int32))], ["a", "b", "hits", "need"]
                )

        keys, hits, many = [], [], 0
        at = 0
        while at < len(row):
            end = max(at + 1, int(np.searchsorted(sums, sums[at] + CHUNK, "right")) - 1)
            some = partners[at:end]
            total = int(some.sum())
            if total:
                i = np.repeat(index[at:end], some)
                j = np.arange(total) - np.repeat(sums[at:end] - sums[at], some) + np.repeat(list_start[at:end], some)
                x, y = row[i], row[j]
                nx, ny = n[x], n[y]
                small_x = (nx < ny) | ((nx == ny) & (order_id[x] < order_id[y]))
                fits = (np.minimum(nx, ny) >= threshold * np.maximum(nx, ny) - 1e-9) & np.where(small_x, near[i], near[j]) & (part[x] != part[y])
                x, y = x[fits], y[fits]
                close = enough(maps.bound(x, y), n[x] + n[y], threshold)
                x, y = x[close], y[close]
                low = np.where(order_id[x] < order_id[y], x, y)
                pair, count = np.unique(low * len(n) + (x + y - low), return_counts=True)
                keys.append(pair)
                hits.append(count)
                many += len(pair)
                if many > HELD_PAIRS:
                    yield from sent(keys, hits)
                    keys, hits, many = [], [], 0
            at = end
        if keys:
            yield from sent(keys, hits)

    return run


def similar_groups(rows: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.5, words: str = "spaced") -> DataFrame:
    """(id, group_id) of every record in a group of two or more; group_id is the smallest id of the group."""
    spark = rows.sparkSession
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    kind = texts.schema["id"].dataType.simpleString()
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = table_bits(chars / PAIR_CHARS, LEAST_BITS, MOST_BITS)
    codes = shipped(spark, slot_codes(texts.select("text"), _slots(words, bits), bits))
    schema = f"id {kind}, n int, f1 bigint, f2 bigint, matches int, bitmap binary, members array<bigint>, leading array<bigint>"
    profiles = materialise(texts.mapInArrow(_profiles(words, threshold, codes, bits), schema), "profiles")

    same = profiles.groupBy("n", "f1", "f2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = profiles.select("id", "n", "f1", "f2").join(same, ["n", "f1", "f2"]).where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    copies = materialise(copies, "copies")
    heads = profiles.join(copies.select(F.col("b").alias("id")), "id", "left_anti")

    starts = heads.select("id", F.explode("leading").alias("key")).distinct()
    leaders = starts.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a")
    likely = materialise(starts.join(leaders, "key").where("id > a").select("a", F.col("id").alias("b")).distinct(), "likely")
    led = verified(likely, texts, words, threshold, "led").select("a", "b")
    release(likely)
    parts = connected_groups(led, "a", "b")

    work = heads.join(parts.select("id", F.col("group_id").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
    # size and matches travel as one number
    work = work.select("id", "part", (F.col("n") * (MOST_MATCHES + 1) + F.col("matches")).alias("shape"), "bitmap", "members", F.xxhash64("id").alias("spread"))
    work = materialise(work, "work")
    release(profiles)
    postings = work.agg(F.sum(F.size("members"))).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(postings / TASK_POSTINGS))
    routed = work.mapInArrow(_routes(tasks, codes, bits), f"task int, id {kind}, part {kind}, shape int, bitmap binary, members array<bigint>")
    met = routed.repartitionById(tasks, F.col("task")).drop("task").mapInArrow(_meet(threshold, kind), f"a {kind}, b {kind}, hits int, need int")
    candidates = met.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.min("need").alias("need")).where("hits >= need")
    candidates = materialise(candidates.select("a", "b"), "candidates")
    release(work)
    close = verified(candidates, texts, words, threshold, "close").select("a", "b")
    release(candidates)
    return connected_groups(copies.union(led).union(close), "a", "b")


def document_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, group_id) of the documents that are revisions of one another."""
    return similar_groups(documents, "doc_id", "text", 0.5, "spaced").withColumnRenamed("id", "doc_id")
