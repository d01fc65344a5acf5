"""Problem 8: token sequences into as few containers of fixed capacity as possible.

Grouping genetic algorithm on islands. Every island holds a bounded share of the items and a
population of packings whose genes are whole bins. Crossover takes well-filled bins of one parent,
removes the bins of the other that hold any of the same items, and puts the displaced items back by
best fit, longest first. After an epoch the best bins of an island, as lists of sizes, migrate to the
next island, which builds them of its own items and goes on. What then still lies in badly filled bins
moves to fewer islands of the same size, as long as that makes them fewer by a quarter; the rest stays as
it is packed. So no island ever holds more than its share, whatever the sizes of the items.

A text longer than the capacity is cut into pieces of the capacity, which are containers of their own,
and a rest that is packed like any other item. No other text is cut. Null and empty texts take no
place. A repeated id is a second item. Without documents or profiles the result is empty; a null or
non-positive capacity packs nothing.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.encode import TOKENIZER_DIR, encode_texts
from quernstone.plans.runtime import materialise

#: Items of an island; packings of a population; crossovers of an epoch; size lists that migrate.
ISLAND_ITEMS = 8_000
POPULATION = 4
CROSSOVERS = 6
ELITES = 200
#: Bins filled less than this leave their island.
WELL_FILLED = 0.99
#: The share of the islands of a level that the next one may have at most.
FEWER = 0.75

Bins = list[list[int]]


class Fitting:
    """Open bins by the room left in them; best fit in a few integer operations."""

    def __init__(self, capacity: int, sizes: list[int]):
        self.capacity, self.sizes = capacity, sizes
        self.by_room: dict[int, list[int]] = defaultdict(list)
        self.rooms = 0
        self.bins: Bins = []

    def _open(self, b: int, room: int) -> None:
        if room:
            self.by_room[room].append(b)
            self.rooms |= 1 << room

    def add_bin(self, items: list[int], room: int) -> None:
        self.bins.append(items)
        self._open(len(self.bins) - 1, room)

    def place(self, item: int) -> None:
        size = self.sizes[item]
        fitting = self.rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            held = self.by_room[room]
            b = held.pop()
            if not held:
                self.rooms &= ~(1 << room)
            self.bins[b].append(item)
            self._open(b, room - size)
        else:
            self.add_bin([item], self.capacity - size)


def best_fit(order: list[int], sizes: list[int], capacity: int, start: Bins | None = None) -> Bins:
    """Best fit of the items in this order, into `start` and new bins."""
    fit = Fitting(capacity, sizes)
    for items in start or []:
        fit.add_bin(list(items), capacity - sum(sizes[i] for i in items))
    for i in order:
        fit.place(i)
    return fit.bins


def fitness(bins: Bins, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more unequal fill (which leaves room in one place)."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(giver: Bins, taker: Bins, sizes: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """A child of the taker with about half of the giver's well-filled bins."""
    full = [b for b in giver if sum(sizes[i] for i in b) >= capacity * WELL_FILLED]
    if not full:
        return taker
    given = [full[i] for i in np.flatnonzero(rng.random(len(full)) < 0.5)]
    taken = {i for b in given for i in b}
    kept, displaced = [], []
    for b in taker:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced.extend(i for i in b if i not in taken)
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(displaced, sizes, capacity, given + kept)


def from_patterns(patterns: list[list[int]], sizes: list[int], capacity: int) -> Bins:
    """A packing with as many bins of the migrated size lists as the own items allow."""
    free: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sizes):
        free[s].append(i)
    bins: Bins = []
    for pattern in patterns:
        need = Counter(pattern)
        while all(len(free[s]) >= k for s, k in need.items()):
            bins.append([free[s].pop() for s in pattern])
    rest = sorted((i for own in free.values() for i in own), key=sizes.__getitem__, reverse=True)
    return best_fit(rest, sizes, capacity, bins)


def evolve(sizes: list[int], capacity: int, seed: int, known: Bins | None = None, patterns: list[list[int]] | None = None) -> Bins:
    """The best packing after one epoch."""
    rng = np.random.default_rng(seed)
    down = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    bound = math.ceil(sum(sizes) / capacity)
    population = [known or best_fit(down, sizes, capacity)]
    if len(population[0]) > bound:
        if patterns:
            population.append(from_patterns(patterns, sizes, capacity))
        while len(population) < POPULATION:
            noise = np.array(sizes) * rng.uniform(0.7, 1.3, len(sizes))
            population.append(best_fit(np.argsort(-noise, kind="stable").tolist(), sizes, capacity))
    scored = sorted(((fitness(b, sizes, capacity), k, b) for k, b in enumerate(population)), reverse=True)
    for step in range(CROSSOVERS):
        if -scored[0][0][0] <= bound:
            break
        i, j = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        i, j = min(i, j), max(i, j)
        child = crossover(scored[j][2], scored[i][2], sizes, capacity, rng)
        scored.append((fitness(child, sizes, capacity), len(population) + step, child))
        scored = sorted(scored, reverse=True)[:POPULATION]
    return scored[0][2]


def _island(epoch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One epoch on the islands of a task; rows with a pattern are migrants from the neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("profile", "ascending"), ("island", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        schema = held[0].schema
        keys = list(zip(t.column("profile").to_pylist(), t.column("island").to_pylist()))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = t.slice(a, b - a)
            pattern = own.column("pattern").combine_chunks()
            moved = pattern.is_valid()
            patterns = own.filter(moved).column("pattern").to_pylist()
            items = own.filter(pa.compute.invert(moved)).combine_chunks()
            if not items.num_rows:
                continue
            sizes, capacity = items.column("size").to_pylist(), items.column("capacity")[0].as_py()
            known = None
            if epoch == 1:
                groups: dict[int, list[int]] = defaultdict(list)
                for i, k in enumerate(items.column("bin").to_pylist()):
                    groups[k].append(i)
                known = list(groups.values())
            bins = evolve(sizes, capacity, keys[a][1] * 2 + epoch, known, patterns)
            number, fill = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
            for k, items_of in enumerate(bins):
                number[items_of] = k
                fill[items_of] = sum(sizes[i] for i in items_of)
            items = items.set_column(items.schema.get_field_index("bin"), "bin", pa.array(number)).set_column(items.schema.get_field_index("fill"), "fill", pa.array(fill))
            yield from items.select(schema.names).cast(schema).to_batches(max_chunksize=20_000)

    return run


def _epoch(items: DataFrame, islands: int, epoch: int) -> DataFrame:
    place = F.pmod(F.col("island") + F.xxhash64("profile"), F.lit(islands)).cast("int")
    return items.repartitionById(islands, place).mapInArrow(_island(epoch), items.schema)


def _elites(items: DataFrame, islands: int) -> DataFrame:
    """The size lists of the best filled bins, most frequent first among equals, on their way to the next island."""
    bins = items.groupBy("profile", "capacity", "island", "bin").agg(F.sort_array(F.collect_list("size"), asc=False).alias("pattern"), F.max("fill").alias("fill"))
    counted = bins.where(F.size("pattern") > 1).groupBy("profile", "capacity", "island", "fill", "pattern").agg(F.count("*").alias("times"))
    best = counted.groupBy("profile", "capacity", "island").agg(F.sort_array(F.collect_list(F.struct("fill", "times", "pattern")), asc=False).alias("all"))
    best = best.select("profile", "capacity", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.explode(F.slice("all", 1, ELITES)).alias("x"))
    return best.select("profile", "capacity", "island", F.col("x.pattern").alias("pattern"))


def _islands(items: DataFrame) -> int:
    most = items.groupBy("profile").count().agg(F.max("count")).first()[0] or 0
    return max(1, math.ceil(most / ISLAND_ITEMS))


def pack(sizes: DataFrame) -> DataFrame:
    """Pack (profile, capacity, doc_id, n_tokens) rows; see pack_documents for the result."""
    pieces = sizes.where("doc_id IS NOT NULL AND n_tokens > 0 AND capacity > 0").select(
        "profile", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1)).alias("piece")
    )
    pieces = pieces.select("profile", "capacity", "doc_id", "piece", F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("size"))
    pieces = materialise(pieces, "pieces")
    name = lambda *c: F.concat_ws("-", "profile", *c)
    whole = pieces.where("size = capacity").select("profile", name(F.lit("full"), "doc_id", "piece", F.monotonically_increasing_id()).alias("container_id"), "doc_id", "piece", "size")
    items = pieces.where("size < capacity")
    islands = _islands(items)
    empty = F.lit(None).cast("int")
    items = items.withColumns({"island": F.pmod(F.xxhash64("doc_id", "piece"), F.lit(islands)).cast("int"), "bin": empty, "fill": empty, "pattern": F.lit(None).cast("array<int>")})
    done, level = [whole], 0
    while True:
        packed = materialise(_epoch(items, islands, 0), f"epoch0-{level}")
        if islands > 1:
            migrants = _elites(packed, islands)
            columns = [F.col(c) if c in migrants.columns else F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in packed.columns]
            packed = materialise(_epoch(packed.unionByName(migrants.select(*columns)), islands, 1), f"epoch1-{level}")
        badly = packed.where(F.col("fill") < F.col("capacity") * WELL_FILLED)
        fewer = _islands(badly) if islands > 1 else islands
        last = fewer > islands * FEWER
        well = packed if last else packed.where(F.col("fill") >= F.col("capacity") * WELL_FILLED)
        done.append(well.select("profile", name(F.lit(str(level)), "island", "bin").alias("container_id"), "doc_id", "piece", "size"))
        if last:
            break
        level, islands = level + 1, fewer
        items = badly.withColumn("island", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(islands)).cast("int"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(documents: DataFrame, profiles: DataFrame, directory: str = TOKENIZER_DIR) -> DataFrame:
    """(profile, container_id, doc_id, piece, size): in which container each document or piece lies.

    `profiles` is a few rows (profile, tokenizer, capacity); piece counts from 0 and is 0 for a document
    that is not cut.
    """
    wanted = profiles.where("profile IS NOT NULL AND tokenizer IS NOT NULL AND capacity > 0").collect()
    parts = []
    for tokenizer in sorted({r.tokenizer for r in wanted}):
        counts = materialise(encode_texts(documents, "doc_id", "text", tokenizer, counts=True, directory=directory), "counts")
        own = F.array(*[F.struct(F.lit(r.profile).alias("profile"), F.lit(r.capacity).cast("int").alias("capacity")) for r in wanted if r.tokenizer == tokenizer])
        parts.append(counts.select(F.explode(own).alias("own"), "id", "n_tokens").select("own.profile", "own.capacity", F.col("id").alias("doc_id"), "n_tokens"))
    if not parts:
        return documents.select(F.lit("").alias("profile"), F.lit("").alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).alias("size")).limit(0)
    sizes = parts[0]
    for part in parts[1:]:
        sizes = sizes.unionByName(part)
    return pack(sizes)
