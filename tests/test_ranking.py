"""Ranks, running sums and gaps over several partitions."""

import random
import time

from pyspark.sql import functions as F

from quernstone.operators import conversation, ranking


def test_numbers_and_sums(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, k int, v int")
    got = {r.id: r.n for r in ranking.numbered(df, [F.desc("k"), F.col("id")], "n").collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {r[0]: i for i, r in enumerate(order)}
    total, want = 0, {}
    for r in order:
        total += r[2]
        want[r[0]] = total
    out = ranking.running(df, [F.desc("k"), F.col("id")], {"s": "v"}).collect()
    assert {r.id: r.s for r in out} == want and {r.all_s for r in out} == {total}
    assert ranking.numbered(df.limit(0), [F.col("id")], "n").count() == 0
    assert ranking.running(df.limit(0), [F.col("id")], {"s": "v"}).count() == 0


def test_sessions_of_a_hot_key(spark):
    rng = random.Random(4)
    rows, clock = [], 0.0
    for i in range(3000):
        clock += rng.choice([1.0, 60.0, 1799.0, 1800.0, 9000.0])
        rows.append(("hot" if i % 3 else f"k{rng.randrange(40)}", clock if i % 50 else clock - 1.0, f"{i:05}"))
    got = {r.ord: r.session for r in conversation.sessions(spark.createDataFrame(rows, "key string, ts double, ord string"), "key", "ts", "ord").collect()}
    want, last = {}, {}
    for k, t, o in sorted(rows):
        if k in last:
            before, n = last[k]
            n += t - before >= 1800
        else:
            n = 0
        last[k] = (t, n)
        want[o] = n
    assert got == want
    assert conversation.sessions(spark.createDataFrame([], "key string, ts double, ord string"), "key", "ts", "ord").count() == 0


def test_risk_over_long_sessions(spark):
    """One session of 30,000 turns beside short ones, over several ranges and many batches, against a plain walk."""
    rng = random.Random(5)
    rows, clock = [], 0.0
    for i in range(32_000):
        clock += rng.choice([1.0, 60.0, 300.0])
        key = "hot" if i < 30_000 else f"k{rng.randrange(300)}"
        labels = rng.choice([[], [], ["x"], ["tool_abuse"]]) if key == "hot" and i < 20_000 else rng.choice([[], ["tool_abuse"], ["role_play_jailbreak"]])
        rows.append((key, clock, f"{i:05}", rng.choice([0.0, 0.05, 0.1, 0.2, rng.random() / 3]), rng.randrange(5), labels, rng.choice([None, 0.2, 0.8])))
    want, last = {}, None
    for key, t, o, s, v, labels, sim in sorted(rows, key=lambda r: r[:3]):
        if not last or last[0] != key or t - last[1] >= conversation.TTL_S:
            session = last[2] + 1 if last and last[0] == key else 0
            turn, risk, had, before, scores = 0, 0.0, False, 0, []
        turn, scores = turn + 1, [*scores, s][-conversation.WINDOW :]
        risk = (risk * 0.5 ** ((t - last[1]) / conversation.HALF_LIFE_S) if turn > 1 else 0.0) + max(0.0, s - conversation.NOISE)
        runs = [(i, j) for i in range(len(scores)) for j in range(i + 2, len(scores)) if all(a < b for a, b in zip(scores[i:j], scores[i + 1 : j + 1]))]
        persona = had or "role_play_jailbreak" in labels
        hard = risk >= 0.6 or (had and "tool_abuse" in labels) or (before >= 3 and sim == 0.2)
        state = 3 if hard else 2 if persona or any(scores[j] - scores[i] >= 0.15 for i, j in runs) else 1 if risk >= 0.15 else 0
        want[o] = (key, session, turn, round(risk, 6), state, max(v, conversation.FLOORS[state]))
        had, before, last = persona, v, (key, t, session)
    df = spark.createDataFrame(rows, "key string, ts double, ord string, score double, verdict int, labels array<string>, sim double")
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(limit)
    spark.conf.set(limit, "700")
    try:
        began = time.monotonic()
        out = conversation.follow(df, "key", "ts", "ord", "score", "verdict", "labels", "sim").collect()
    finally:
        spark.conf.set(limit, usual)
    assert time.monotonic() - began < 60
    assert {r.ord: (r.key, r.session, r.turn, round(r.risk, 6), r.state, r.floored) for r in out} == want
    assert len({r.state for r in out}) == 4 and max(r.turn for r in out) == 30_000


def test_similarity_of_turns_by_their_vectors(spark):
    """Turns that come with vectors are followed as turns that come with their similarity to the one before."""
    rng = random.Random(6)
    rows, before = [], {}
    for i in range(600):
        key = "hot" if i % 6 else f"k{i % 7}"
        vector = rng.choice([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]])
        sim = sum(a * b for a, b in zip(vector, before[key])) if key in before else None
        before[key] = vector
        rows.append((key, i * 200.0, f"{i:05}", 0.05, rng.randrange(5), [], sim, vector))
    df = spark.createDataFrame(rows, "key string, ts double, ord string, score double, verdict int, labels array<string>, sim double, vector array<float>")
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(limit)
    spark.conf.set(limit, "50")
    columns = ("key", "ts", "ord", "score", "verdict", "labels")
    try:
        want = conversation.follow(df, *columns, "sim").orderBy("ord").collect()
        got = conversation.follow(df, *columns, vector_col="vector").orderBy("ord").collect()
    finally:
        spark.conf.set(limit, usual)
    assert got == want and len({r.state for r in got}) == 2
