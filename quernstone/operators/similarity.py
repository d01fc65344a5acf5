"""Similar texts by their shingles: exact similarity join by prefixes, MinHash signatures, the exact check of candidates.

Shingles are 48-bit hashes made from whole batches of texts at once. A table counts them over all rows, and
every set is put in that order, rarest first. Sets of the similarity t share a member of their prefixes of
n - ceil(t n) + 1, so only those prefixes meet, without members that occur once. A member of very many
rows is cut into a grid of blocks as fine as it is frequent, so that no join key holds more than about two
blocks of HOT rows; a pair still meets once for each member it shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.kernels import SpanHash, code_points, mix, pair_sets, word_spans
from quernstone.functions.sketch import code_values, id_bits, id_filter, id_slot, received, shipped, slot_codes, table_bits
from quernstone.plans.runtime import materialise, release, text_slices

Sets = Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]

#: Bounds of the count table (log2 of its bytes), the characters a shingle takes up, rows of a block.
LEAST_BITS, MOST_BITS = 18, 26
SHINGLE_CHARS = 6
HOT = 20_000
#: Low bits of a posting: second block of a cell, cell of two blocks.
SIDE, CROSS = 1, 2
#: 64-bit words of a bit map of a set.
MAP_WORDS = 4
MAP_COLUMNS = [f"m{k}" for k in range(MAP_WORDS)]


@lru_cache(maxsize=1)
def _plain_letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]] = True
    return table


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct pairs of words a-z0-9 of each text, and their offsets.

    A text of one word has that word as its shingle, one without words a mark that all such texts share.
    """
    known = [t or "" for t in texts]
    values, offsets = pair_sets(known, _plain_letters())
    bare = np.flatnonzero(np.diff(offsets) == 0)
    if not len(bare):
        return values, offsets
    codes, starts = code_points([known[i].lower() for i in bare])
    s, e, row = word_spans(codes, starts, _plain_letters())
    alone = np.full(len(bare), np.uint64(0x5EED) << np.uint64(16), np.uint64)
    if len(s):
        alone[row] = mix(SpanHash(codes).of(s, e)) & ~np.uint64(0xFFFF)
    values = np.insert(values, offsets[bare], alone)
    n = np.diff(offsets)
    n[bare] = 1
    return values, np.concatenate([[0], np.cumsum(n)])


def enough(overlap: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these sizes together, with this overlap, have the similarity."""
    return overlap * (1 + threshold) >= threshold * sizes - 1e-9


def bit_maps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MAP_WORDS words with one bit set for each member of each set."""
    n = len(starts) - 1
    marks = np.zeros((n, MAP_WORDS * 64), np.uint8)
    marks[np.repeat(np.arange(n), np.diff(starts)), ((values >> np.uint64(40)) % np.uint64(MAP_WORDS * 64)).astype(np.int64)] = 1
    return np.packbits(marks, axis=1, bitorder="little").view(np.int64)


def may_overlap(threshold: float) -> Column:
    """Whether the bit maps of the sets x and y leave room for the overlap that the similarity asks for."""
    shared = sum((F.bit_count(F.col(f"x.m{k}").bitwiseAND(F.col(f"y.m{k}"))) for k in range(1, MAP_WORDS)), F.bit_count(F.col("x.m0").bitwiseAND(F.col("y.m0"))))
    most = shared + F.least("x.spare", "y.spare")
    return most * (1 + threshold) >= (F.col("x.n") + F.col("y.n")) * threshold - 1e-9


# -- the exact check -----------------------------------------------------------------------------


def _sieved(sieve: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = received(sieve)
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            hit = (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1
            yield batch.select(["id", "text"]).filter(pa.array(hit.astype(bool)))

    return run


def _sets(sets: Sets) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                values, offsets = sets(batch.column("text").to_pylist())
                members = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(members, pa.binary())], ["id", "members"])

    return run


def _check(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            overlap, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                overlap[i] = np.count_nonzero(y[at] == x) if len(y) else 0
                sizes[i] = len(x) + len(y)
            good = enough(overlap, sizes, threshold) & (overlap > 0)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(overlap / np.maximum(sizes - overlap, 1))], ["a", "b", "similarity"])
            yield out.filter(pa.array(good))

    return run


def verified(candidates: DataFrame, texts: DataFrame, sets: Sets, threshold: float, label: str) -> DataFrame:
    """A table of the candidate pairs (a, b) whose texts (id, text) have at least the similarity, with it.

    Only texts that occur in a pair are shuffled, as they are, and turned into sets then. While the ids fit
    a bit table of bounded size it sieves the scan; an exact semi-join follows in any case.
    """
    spark = texts.sparkSession
    candidates = candidates.select("a", "b")
    ids = materialise(candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct(), "ids")
    kind = texts.schema["id"].dataType.simpleString()
    texts, bits = texts.select("id", "text"), id_bits(ids.count())
    if bits:
        sieve = shipped(spark, id_filter(ids, bits))
        texts = texts.select("id", "text", id_slot("id", bits)).mapInArrow(_sieved(sieve), f"id {kind}, text string")
    own = texts.join(ids, "id", "left_semi").dropDuplicates(["id"])
    held = materialise(own.mapInArrow(_sets(sets), f"id {kind}, members binary"), "sets")
    x = held.select(F.col("id").alias("a"), F.col("members").alias("x"))
    y = held.select(F.col("id").alias("b"), F.col("members").alias("y"))
    checked = candidates.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_check(threshold), f"a {kind}, b {kind}, similarity double")
    checked = materialise(checked, label)
    release(ids, held)
    return checked


# -- the similarity join -------------------------------------------------------------------------


def _slots(sets: Sets, bits: int) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    def run(whole: pa.RecordBatch) -> Iterator[np.ndarray]:
        for batch in text_slices(whole, "text"):
            yield (sets(batch.column("text").to_pylist())[0] >> np.uint64(64 - bits)).astype(np.int64)

    return run


def _profiles(sets: Sets, threshold: float, codes: object, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, blocks_of = received(codes), np.ceil(code_values() / HOT).astype(np.int64)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                values, starts = sets(batch.column("text").to_pylist())
                n = np.diff(starts)
                if not len(values):
                    continue
                row = np.repeat(np.arange(len(n)), n)
                prints = [np.add.reduceat(mix(values + np.uint64(s)), starts[:-1]) for s in (17, 71)]
                maps = bit_maps(values, starts)
                spare = (n - np.bitwise_count(maps.view(np.uint64)).sum(axis=1)).astype(np.int32)
                code = table[(values >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.argsort((row << 8) | code, kind="stable")
                values, code = values[order], code[order]
                prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
                inside = (np.arange(len(row)) - starts[row] < prefix[row]) & (code > 1)
                member, owner, blocks = values[inside], row[inside], blocks_of[code[inside]]
                which, cells = block_cells(member, prints[0][owner], blocks)
                lists = np.concatenate([[0], np.cumsum(np.bincount(owner[which], minlength=len(n)))]).astype(np.int32)
                columns = [batch.column("id"), pa.array(n.astype(np.int32)), *(pa.array(p.view(np.int64)) for p in prints), pa.array(spare), *(pa.array(maps[:, k].copy()) for k in range(MAP_WORDS)), pa.ListArray.from_arrays(pa.array(lists), pa.array(cells.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "f1", "f2", "spare", *MAP_COLUMNS, "members"])

    return run


def block_cells(member: np.ndarray, spread: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where postings meet, as (which posting, key): by their member, or in the cells of their block's row of a grid."""
    own = (mix(spread) % blocks.astype(np.uint64)).astype(np.int64)
    which = np.repeat(np.arange(len(member)), blocks)
    other = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own, many = own[which], blocks[which] > 1
    cell = (np.minimum(own, other) * blocks[which] + np.maximum(own, other) + 1).astype(np.uint64)
    key = np.where(many, mix(member[which] + mix(cell)), member[which]) & ~np.uint64(SIDE | CROSS)
    return which, key | np.where(own > other, np.uint64(SIDE), np.uint64(0)) | np.where(own != other, np.uint64(CROSS), np.uint64(0))


def similar_pairs(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, sets: Sets = shingle_sets) -> DataFrame:
    """(a, b): pairs of different sets with at least the similarity, each set by its least id; and copies with it.

    Rows with the same set are one head, so a large group of copies is linked to it in a star. Null ids and
    texts are left out.
    """
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    spark, kind = rows.sparkSession, texts.schema["id"].dataType.simpleString()
    bits = table_bits((texts.agg(F.sum(F.length("text"))).first()[0] or 0) / SHINGLE_CHARS, LEAST_BITS, MOST_BITS)
    codes = shipped(spark, slot_codes(texts.select("text"), _slots(sets, bits), bits))
    schema = f"id {kind}, n int, f1 bigint, f2 bigint, spare int, " + ", ".join(f"{m} bigint" for m in MAP_COLUMNS) + ", members array<bigint>"
    profiles = materialise(texts.mapInArrow(_profiles(sets, threshold, codes, bits), schema), "profiles")
    same = profiles.groupBy("n", "f1", "f2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = materialise(profiles.select("id", "n", "f1", "f2").join(same, ["n", "f1", "f2"]).where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "copies")
    heads = profiles.join(copies.select(F.col("b").alias("id")), "id", "left_anti")
    heads = materialise(heads, "heads")
    release(profiles)
    # a posting carries the map of its set folded to half, which ends most pairs where they arise
    half = MAP_WORDS // 2
    folded = [F.col(f"m{k}").bitwiseOR(F.col(f"m{k + half}")).alias(f"w{k}") for k in range(half)]
    each = heads.select("id", "n", *folded, F.explode("members").alias("m")).select("id", "n", *[f"w{k}" for k in range(half)], F.col("m").bitwiseAND(F.lit(~SIDE)).alias("key"), F.col("m").bitwiseAND(F.lit(SIDE)).cast("tinyint").alias("side"))
    x, y = each.alias("x"), each.alias("y")
    total = lambda columns: reduce(lambda u, v: u + v, [F.bit_count(c) for c in columns])
    spare = lambda side: F.col(f"{side}.n") - total([F.col(f"{side}.w{k}") for k in range(half)])
    most = total([F.col(f"x.w{k}").bitwiseAND(F.col(f"y.w{k}")) for k in range(half)]) + F.least(spare("x"), spare("y"))
    room = most * (1 + threshold) >= (F.col("x.n") + F.col("y.n")) * threshold - 1e-9
    apart = F.when(F.col("x.key").bitwiseAND(F.lit(CROSS)) > 0, F.col("x.side") < F.col("y.side")).otherwise(F.col("x.id") < F.col("y.id"))
    fits = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold
    met = x.join(y, F.col("x.key") == F.col("y.key")).where(apart & fits & room).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    met = materialise(met, "met")
    maps = heads.select("id", "n", "spare", *MAP_COLUMNS)
    hopeful = met.join(maps.alias("x"), F.col("a") == F.col("x.id")).join(maps.alias("y"), F.col("b") == F.col("y.id")).where(may_overlap(threshold)).select("a", "b")
    hopeful = materialise(hopeful, "hopeful")
    release(met, heads)
    close = verified(hopeful, texts, sets, threshold, "close").select("a", "b")
    release(hopeful)
    return close.unionByName(copies)


# -- MinHash -------------------------------------------------------------------------------------


def minhash(values: np.ndarray, starts: np.ndarray, permutations: int = 128) -> np.ndarray:
    """The least member of each (not empty) set under each of so many hash functions."""
    out = np.empty((permutations, len(starts) - 1), np.uint64)
    for k in range(permutations):
        out[k] = np.minimum.reduceat(mix(values ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)), starts[:-1])
    return out.T


def minhash_signatures(rows: DataFrame, id_col: str, text_col: str, permutations: int = 128, sets: Sets = shingle_sets) -> DataFrame:
    """(id, signature): an array of the minwise hashes of each text's shingles. Null texts are left out."""
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                values, starts = sets(batch.column("text").to_pylist())
                flat = minhash(values, starts, permutations).reshape(-1).view(np.int64)
                ends = pa.array((np.arange(batch.num_rows + 1) * permutations).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(flat))], ["id", "signature"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, signature array<bigint>")


def signature_similarity(a: Column, b: Column) -> Column:
    """The estimate of the similarity: the share of hash functions that agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x) / F.size(a)


def lsh_candidates(signatures: DataFrame, bands: int = 42, rows: int = 3) -> DataFrame:
    """(a, b): rows (id, signature) that agree in a whole band, each linked to the least of its bucket.

    42 bands of 3 find a pair of similarity 0.5 with a chance of 99.6 %; a bucket gives a star, not all pairs.
    """
    keys = F.array(*[F.xxhash64(F.lit(k), F.slice("signature", k * rows + 1, rows)) for k in range(bands)])
    each = signatures.select("id", F.explode(keys).alias("bucket"))
    least = each.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("bucket", "a")
    return each.join(least, "bucket").where("id > a").select("a", F.col("id").alias("b")).distinct()
