"""Copies, splits, overlaps, near-duplicates and groups against brute force on small fixtures."""

import random
import re
from collections import defaultdict

import pytest

from quernstone.llm import components, copies, neardup, overlap, splits

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty karst ledge marsh north otter plume quill ridge slope tidal".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


# -- groups ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell", [2, 50, 10**6])
def test_groups_match_union_find(spark, cell):
    rng = random.Random(cell)
    pairs = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(200)]
    pairs += [("hub", f"s{i:03}") for i in range(120)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    pairs += [(b, a) for a, b in pairs[:30]] + pairs[:10] + [(None, "x"), ("x", None), ("self", "self")]
    df = spark.createDataFrame([(a, b, 0.5, "extra") for a, b in pairs], "src string, dst string, v double, group_id string")
    got = {r.id: r.group_id for r in components.connected_groups(df, cell_edges=cell).collect()}
    assert got == roots([(a, b) for a, b in pairs if a and b and a != b])


def test_groups_of_integers_and_of_nothing(spark):
    df = spark.createDataFrame([(5, 3), (3, 9), (7, 8)], "src long, dst long")
    assert {tuple(r) for r in components.connected_groups(df).collect()} == {(3, 3), (5, 3), (9, 3), (7, 7), (8, 7)}
    assert components.connected_groups(df.limit(0)).count() == 0
    assert components.connected_groups(spark.createDataFrame([(None, 3), (4, 4)], "src long, dst long")).count() == 0


# -- copies ----------------------------------------------------------------------------------------

TEXTS = [
    ("a1", "Hello, World!", "train"), ("a2", "hello world", "train"), ("a3", "HELLO\tWORLD", "test"), ("a4", "hello​world", "train"),
    ("b1", "", "train"), ("b2", "...", "train"), ("b3", None, "train"), ("b4", "  ", "train"),
    ("c1", "ΟΔΟΣ", "train"), ("c2", "οδος", "train"), ("d1", "hеllo world", "train"), ("e1", "café", "train"), ("e2", "café", "train"), ("e3", "CAFE", "train"),
    ("f1", "x" * 300_000, None), ("f2", "X " * 300_000, None), ("f3", "x" * 300_001, None), ("a2", "hello world", "train"),
]


def test_copies_of_texts(spark):
    df = spark.createDataFrame([(*t, "z", 1) for t in TEXTS], "id string, text string, source_split string, split string, h1 int")
    got = sorted(tuple(r) for r in copies.formatting_copies(df, split_col="source_split").collect())
    groups = defaultdict(set)
    for i, t, s in TEXTS:
        if t and copies.folded(t):
            groups[s, copies.folded(t)].add(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert got == want and ("a1", "a4") in got and ("c1", "c2") in got and ("f1", "f2") in got and ("e1", "e3") in got


def test_collisions_are_told_apart(spark, monkeypatch):
    assert copies.same_folded("A-b c", "abC") and not copies.same_folded("abc", "abcd") and not copies.same_folded("", "a")
    rows = [("a", "s", "m", "One two", "three"), ("b", "s", "m", "one TWO", "three")]
    batch = spark.createDataFrame(rows, "id string, split string, first_id string, text string, first_text string").toArrow().to_batches()
    out = [r for b in copies._compared(False)(iter(batch)) for r in b.to_pylist()]
    assert [r["form"] for r in out] == ["onetwo", "onetwo"]


def test_copies_of_payloads(spark):
    rows = [
        ("r1", '{"a": 1, "b": {"c": "Hi there", "d": [1, 2]}}'), ("r2", '{"b":{"d":[1,2.0],"c":"hi, THERE"},"a":1.0}'), ("r3", '{"a": 1, "b": {"c": "Hi there", "d": [2, 1]}}'),
        ("r4", '{"a": true, "b": {"c": "Hi there", "d": [1, 2]}}'), ("r5", '{"a": 1'), ("r6", None), ("r7", '{"a": 1, "b": null}'), ("r8", '{"b": null, "a": 1}'), ("r9", '{"a": 1}'), ("s1", "NaN"), ("s2", "NaN"), ("s3", "[" * 5000), ("s4", ""),
    ]
    df = spark.createDataFrame(rows, "id string, payload string")
    assert sorted(tuple(r) for r in copies.formatting_copies(df, text_col="payload", json_rows=True).collect()) == [("r1", "r2"), ("r7", "r8")]
    assert copies.formatting_copies(df.limit(0), text_col="payload", json_rows=True).count() == 0


def test_copy_counts(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "e")], "first_id string, copy_id string")
    assert {tuple(r) for r in copies.copy_counts(df).collect()} == {("a", 3), ("d", 2)}


# -- splits ----------------------------------------------------------------------------------------


def corpus(spark, rows):
    return spark.createDataFrame(rows, "id string, source string, family string, source_split string, part string, rows int")


def test_torn_groups(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        s = rng.choice([None, f"src {rng.randrange(60)}", f"SRC-{rng.randrange(60)}", f"src_{rng.randrange(60)}"])
        rows.append((f"r{i:03}", s, rng.choice([None, None, f"f{rng.randrange(90)}"]), rng.choice(["train", "test", "validation", "unassigned", None]), "x", 1))
    nodes = roots([(f"i{r[0]}", k) for r in rows for k in ([f"s{re.sub(r'[ _-]', '', r[1].lower())}"] if r[1] else []) + ([f"f{r[2]}"] if r[2] else [])])
    groups = defaultdict(list)
    for r in rows:
        groups[nodes.get(f"i{r[0]}", r[0])].append(r)
    want = {min(r[0] for r in g) for g in groups.values() if len({r[3] for r in g} & {"train", "test", "validation"}) > 1}
    df = corpus(spark, rows)
    assert {r.group_id for r in splits.torn_groups(df).collect()} == want
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    got = splits.assign_splits(df, targets).toPandas()
    assert len(got) == 300 and got.groupby("group_id").split_name.nunique().max() == 1


def test_large_groups_draw_where_there_is_room(spark):
    sizes = [300, 250, 90, 60, 40, *([2] * 130)]
    rows = [(f"r{g:03}{i:03}", f"s{g}", None, None, "x", 1) for g, n in enumerate(sizes) for i in range(n)]
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    got = splits.assign_splits(corpus(spark, rows), targets).toPandas()
    assert len(got) == len(rows) and got.groupby("group_id").split_name.nunique().max() == 1
    shares = got.split_name.value_counts(normalize=True)
    assert abs(shares["train"] - 0.8) < 0.04 and abs(shares["test"] - 0.1) < 0.03 and abs(shares["validation"] - 0.1) < 0.03


def test_shares_are_met(spark):
    rows = [(f"r{i:05}", f"s{i // 3}", None, None, "x", 1) for i in range(6000)]
    targets = spark.createDataFrame([("train", 8.0), ("validation", 1.0), ("test", 1.0), (None, 3.0), ("none", 0.0)], "split_name string, share double")
    got = splits.assign_splits(corpus(spark, rows), targets).toPandas().split_name.value_counts(normalize=True)
    assert abs(got["train"] - 0.8) < 0.03 and abs(got["test"] - 0.1) < 0.02 and "none" not in got
    assert splits.torn_groups(corpus(spark, rows).limit(0)).count() == 0
    assert splits.assign_splits(corpus(spark, rows).limit(0), targets).count() == 0


# -- similar texts ---------------------------------------------------------------------------------


def pairs_of(text, pattern):
    w = re.findall(pattern, text.lower())
    return set(zip(w, w[1:]))


def similar(a, b):
    return bool(a and b) and 2 * len(a & b) >= len(a | b)


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        base = sentence(rng, rng.randrange(3, 60))
        out += [base, *(edited(rng, base, rng.randrange(0, 12)) for _ in range(rng.randrange(0, 4)))]
    hot = sentence(rng, 30)
    out += [edited(rng, hot, 1) for _ in range(40)] + [hot] * 5 + ["", None, "one", "  ", "two words", "Two\nwords", "w " * 60_000]
    rng.shuffle(out)
    return out


def test_similar_groups(spark):
    rows = [(i, t, "x", 3) for i, t in enumerate(texts(3))]
    got = {tuple(r) for r in neardup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string, id string, n int"), "doc_id").collect()}
    sets = {i: pairs_of(t or "", r"[^ \t\r\n]+") for i, t, *_ in rows}
    links = [(i, j) for i in sets for j in sets if i < j and similar(sets[i], sets[j])]
    assert got == set(roots(links).items())


def test_hot_members_are_cut_into_blocks(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(4))]
    df = spark.createDataFrame(rows, "id long, text string")
    want = {tuple(r) for r in neardup.similar_groups(df).collect()}
    monkeypatch.setattr(neardup, "HOT", 12)
    monkeypatch.setattr(neardup, "CHUNK", 50)
    monkeypatch.setattr(neardup, "HELD_PAIRS", 10)
    monkeypatch.setattr(neardup, "MOST_BITS", 10)
    monkeypatch.setattr(neardup, "LEAST_BITS", 10)
    assert {tuple(r) for r in neardup.similar_groups(df).collect()} == want and want


def test_a_pair_meets_once_in_the_cells_of_a_member():
    import numpy as np

    docs, blocks = 200, 5
    member = np.full(docs, 8 << 3, np.uint64)
    which, cells = neardup.cells_of(member, np.arange(docs).astype(np.uint64), np.full(docs, blocks))
    lists = defaultdict(list)
    for d, c in zip(which.tolist(), cells.tolist()):
        lists[c & ~3].append((d, bool(c & neardup.SIDE)))
    met = []
    for c, held in lists.items():
        if c & neardup.CROSS:
            met += [(min(x, y), max(x, y)) for x, s in held if s for y, t in held if not t]
        else:
            met += [(x, y) for i, (x, _) in enumerate(held) for y, _ in held[:i]]
    assert len(met) == docs * (docs - 1) // 2 == len({tuple(sorted(p)) for p in met}) and max(map(len, lists.values())) < docs


def test_near_copies_share_a_leader():
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    docs = [np.concatenate([rng.permutation(base)[:54], rng.integers(0, 1 << 63, 6).astype(np.uint64)]) for _ in range(300)]
    keys = neardup._leading(np.concatenate(docs), np.array([len(d) for d in docs])).to_pylist()
    groups = roots([(f"d{i:03}", f"k{k}") for i, own in enumerate(keys) for k in own])
    assert all(len(own) == neardup.KEYS for own in keys)
    most = defaultdict(int)
    for i in range(300):
        most[groups[f"d{i:03}"]] += 1
    assert max(most.values()) > 280
    assert neardup._leading(np.zeros(0, np.uint64), np.zeros(3, np.int64)).to_pylist() == [[], [], []]


def test_no_similar_groups(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (None, "a b c")], "id long, text string")
    assert neardup.similar_groups(df).count() == 0
    assert neardup.similar_groups(df.limit(0)).count() == 0


def test_split_overlaps(spark):
    rng = random.Random(9)
    rows = [(f"r{i:03}", t, rng.choice(["train", "train", "test", "validation", "unassigned", None]), rng.choice(["s", None]), 7) for i, t in enumerate(texts(5))]
    df = spark.createDataFrame(rows, "id string, text string, source_split string, source string, n int")
    found = overlap.split_overlaps(df)
    sets = {i: pairs_of(t or "", r"[^\W_]+") for i, t, *_ in rows}
    side = {r[0]: r[2] for r in rows}
    want = {(i, j) for i in sets for j in sets if i < j and similar(sets[i], sets[j]) and "train" in (side[i], side[j]) and {side[i], side[j]} & {"test", "validation"}}
    got = {tuple(r) for r in found.collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and want
    report = overlap.overlap_report(df).toPandas()
    assert report["pairs"].sum() == len(got) and set(report["split"]) <= {"test", "validation"}
    assert overlap.split_overlaps(df.limit(0)).count() == 0 and overlap.overlap_report(df.limit(0)).count() == 0


def test_hot_buckets_leave_in_chunks(spark, monkeypatch):
    rng = random.Random(2)
    hot = sentence(rng, 40)
    rows = [(f"r{i:03}", edited(rng, hot, 2), rng.choice(["train", "test"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, text string, source_split string")
    want = {tuple(r) for r in overlap.split_overlaps(df).collect()}
    for name, value in (("HOT_PAIRS", 40), ("CHUNK_ENTRIES", 7), ("PAIRS_AT_ONCE", 100), ("REMEMBERED", 10)):
        monkeypatch.setattr(overlap, name, value)
    assert {tuple(r) for r in overlap.split_overlaps(df).collect()} == want and len(want) > 1000
    monkeypatch.setattr(overlap, "STRETCH_ENTRIES", 50)
    assert {tuple(r) for r in overlap.split_overlaps(df).collect()} == want


def test_recall_of_buckets():
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(60)]
    import numpy as np

    missed = 0
    for _ in range(300):
        kept = sorted(rng.sample(base, 40))
        a = np.array(sorted([*kept, *(rng.getrandbits(64) for _ in range(20))]), np.uint64)
        b = np.array(sorted([*kept, *(rng.getrandbits(64) for _ in range(20))]), np.uint64)
        x, y = overlap.minwise_bands(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        missed += not (x == y).any()
    assert missed <= 3
