"""Problem 2: splits that keep related records together.

Rows name a source (in any spelling) and a family; the distinct pairs of both are the edges of a
graph that is far smaller than the rows. Hash-to-min finds its components: every node holds a cluster
of nodes, each round sends the cluster to its smallest member and that member to all others, until
nothing changes. The clusters are rows of a relation, so even one that holds a third of all nodes is
spread over tasks.

Components get splits by weighted rendezvous hashing: the split with the best -ln(u)/weight of a hash
u of component and split, where the weights are the rows that the splits still miss. Components above a
thousandth of all rows, at most a thousand of them, draw one after the other, largest first, among the
splits that have room for them; all others then draw at once.

Null sources and families link nothing; rows without both are groups of their own. Rows with a null
id are in no group. Groups of rows that stand in no split are torn by none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.plans.runtime import materialise

#: A component with more than this share of the rows draws by itself, and joins it by a broadcast.
LARGE = 0.001
SPLITS = ("train", "validation", "test")


def source_key(source: Column) -> Column:
    """One spelling of a source: lower case without white space, hyphens and underscores."""
    return F.regexp_replace(F.lower(source), "(?U)[\\s_\\-‐‑]", "")


def with_looked_up(rows: DataFrame, lookup: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined (left) with a lookup of one row a key; keys of more than LARGE of the rows by a broadcast of at most 1 / LARGE rows."""
    large = F.broadcast(materialise(rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > total * LARGE).select(key).join(lookup, key, "left"), "large"))
    usual = rows.join(large.select(key), key, "left_anti").join(lookup, key, "left")
    return usual.unionByName(rows.join(large, key))


def hash_to_min(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the edges (a, b): root is the smallest node of the component."""
    clusters = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a"))
    nodes = clusters.select("v", F.col("v").alias("u"))
    clusters = materialise(clusters.union(nodes).distinct(), "clusters")
    before = None
    while True:
        mark = clusters.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == before:
            break
        before = mark
        least = clusters.groupBy("v").agg(F.min("u").alias("m"))
        sent = clusters.join(least, "v").select("m", "u")
        clusters = materialise(sent.select(F.col("m").alias("v"), "u").union(sent.select("u", "m")).distinct(), "clusters")
    return clusters.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))


def related_rows(rows: DataFrame, id_col: str = "id", source_col: str = "source", family_col: str = "family", split_col: str = "source_split") -> DataFrame:
    """(id, split, part): rows with the component they belong to."""
    source = F.concat(F.lit("s:"), source_key(F.col(source_col)))
    family = F.concat(F.lit("f:"), F.col(family_col))
    keyed = rows.select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), source.alias("s"), family.alias("f")).where("id IS NOT NULL")
    edges = keyed.where("s IS NOT NULL AND f IS NOT NULL").select(F.col("s").alias("a"), F.col("f").alias("b")).distinct()
    roots = hash_to_min(edges)
    nodes = keyed.select("id", "split", F.coalesce("s", "f").alias("node"))
    return with_looked_up(nodes, roots, "node", keyed.count()).select("id", "split", F.coalesce("root", "node", F.concat(F.lit("r:"), F.col("id").cast("string"))).alias("part"))


def related_groups(related: DataFrame) -> DataFrame:
    """(part, group_id, rows, splits) of each component; splits counts those of train, validation and test that occur."""
    within = [F.max((F.col("split") == s).cast("int")) for s in SPLITS]
    splits = sum((F.coalesce(w, F.lit(0)) for w in within[1:]), F.coalesce(within[0], F.lit(0)))
    return related.groupBy("part").agg(F.min("id").alias("group_id"), F.count("*").alias("rows"), splits.alias("splits"))


def torn_groups(rows: DataFrame) -> DataFrame:
    """(group_id): groups whose rows stand in at least two of train, validation and test."""
    return related_groups(related_rows(rows)).where("splits >= 2").select("group_id")


def assign_splits(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, group_id, split_name) of every row, whole groups to one split.

    `targets` is (split_name, share): a few rows; shares need not add up to one. Without targets no row
    gets a split.
    """
    related = materialise(related_rows(rows), "related")
    groups = materialise(related_groups(related), "groups")
    shares = {r.split_name: float(r.share) for r in targets.where("split_name IS NOT NULL AND share > 0").collect()}
    if not shares:
        return related.join(groups, "part").select("id", "group_id", F.lit(None).cast("string").alias("split_name"))
    total = groups.agg(F.sum("rows")).first()[0] or 0
    whole = sum(shares.values())
    missing = {s: total * w / whole for s, w in sorted(shares.items())}
    drawn = lambda s: -F.log((F.shiftrightunsigned(F.xxhash64("part", F.lit(s)), 11) + 1) / float(1 << 53))
    placed = []
    alone = groups.where(F.col("rows") > total * LARGE).select("part", "group_id", "rows", *[drawn(s).alias(f"draw {s}") for s in missing])
    for g in alone.orderBy(F.desc("rows"), "group_id").collect():
        fits = [s for s, left in missing.items() if left >= g.rows] or [max(missing, key=missing.get)]
        best = min(fits, key=lambda s: g[f"draw {s}"] / max(missing[s], 1e-9))
        placed.append((g.part, str(g.group_id), best))
        missing[best] -= g.rows
    weights = {s: w for s, w in missing.items() if w > 0} or {s: 1.0 for s in missing}
    draws = [F.struct((drawn(s) / w).alias("cost"), F.lit(s).alias("split")) for s, w in weights.items()]
    draw = F.least(*draws) if len(draws) > 1 else draws[0]
    large = F.broadcast(rows.sparkSession.createDataFrame(placed, "part string, group_id string, split_name string").withColumn("group_id", F.col("group_id").cast(groups.schema["group_id"].dataType)))
    usual = groups.join(large.select("part"), "part", "left_anti").select("part", "group_id", draw["split"].alias("split_name"))
    rest = related.join(large.select("part"), "part", "left_anti").join(usual, "part")
    return rest.unionByName(related.join(large, "part")).select("id", "group_id", "split_name")
