"""Risk across the turns of a conversation: a fold over its turns in order of time.

Turns are cut into sessions where the gap reaches the time to live. `folded` walks an array of turns, as a
stream has them: few at a time, since it copies its steps at every turn. `follow` walks whole tables: turns are
range-partitioned in order, every range is walked once by Arrow batches, and what the ranges before it leave
behind is added to the rows that go on with their last session. So one session may span many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quernstone.operators.ranking import after_gaps, ranged
from quernstone.operators.scoring import VERDICTS
from quernstone.operators.vectors import _matrix
from quernstone.plans.runtime import materialise

STATES = ("normal", "probing", "establishing", "exploiting")
HALF_LIFE_S = 300.0
TTL_S = 1800.0
WINDOW = 8
RUN, RISE = 3, 0.15
NOISE = 0.05
PROBING, EXPLOITING = 0.15, 0.6
PIVOT = 0.3
# The label that sets a persona, and the labels that escalate.
PERSONA = "role_play_jailbreak"
ESCALATION = ("direct_override", "system_prompt_extraction", "data_exfiltration", "tool_abuse")
#: Least verdict by state: none, none, flag, challenge.
FLOORS = (0, 0, 1, 3)


def crescendo(scores: Column) -> Column:
    """Whether the scores hold a strictly rising run of three or more that rises by 0.15."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("first"), F.lit(0).alias("n"), F.lit(False).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        goes = acc["last"].isNotNull() & (x > acc["last"])
        first = F.when(goes, acc["first"]).otherwise(x)
        n = F.when(goes, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), first.alias("first"), n.alias("n"), (acc["hit"] | ((n >= RUN) & (x - first >= RISE))).alias("hit"))

    return F.aggregate(scores, start, step, lambda acc: acc["hit"])


def floor_rank(state: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in FLOORS]), state + 1)


def state_of(risk: Column, rising: Column, drift: Column, pivot: Column, persona: Column) -> Column:
    return F.when(drift | pivot | (risk >= EXPLOITING), 3).when(persona | rising, 2).when(risk >= PROBING, 1).otherwise(0)


def sessions(turns: DataFrame, key_col: str, ts_col: str, order_col: str, ttl_s: float = TTL_S) -> DataFrame:
    """turns with a session number per key: a gap of the time to live or more begins a new one."""
    return after_gaps(turns, key_col, ts_col, order_col, ttl_s, "session")


_TURN = "struct<ts:double,ord:string,score:double,verdict:int,labels:array<string>,similarity:double>"
_STEP = "struct<ts:double,ord:string,risk:double,state:int,turn:int,verdict:int,floored:int>"
_RECORD = f"struct<state:int,turn:int,risk:double,last:double,labels:array<string>,scores:array<double>,verdict:int,out:array<{_STEP}>>"


def _advance(half_life_s: float):
    def step(acc: Column, t: Column) -> Column:
        waited = F.greatest(F.lit(0.0), t["ts"] - acc["last"])
        risk = acc["risk"] * F.pow(F.lit(0.5), waited / half_life_s) + F.greatest(F.lit(0.0), t["score"] - NOISE)
        scores = F.concat(acc["scores"], F.array(t["score"]))
        scores = F.when(F.size(scores) > WINDOW, F.slice(scores, -WINDOW, WINDOW)).otherwise(scores)
        had = F.array_contains(acc["labels"], PERSONA)
        drift = had & F.arrays_overlap(t["labels"], F.array(*[F.lit(x) for x in ESCALATION]))
        pivot = (acc["verdict"] >= 3) & F.coalesce(t["similarity"] < PIVOT, F.lit(False))
        state = state_of(risk, crescendo(scores), drift, pivot, had | F.array_contains(t["labels"], PERSONA))
        turn = acc["turn"] + 1
        seen = F.struct(t["ts"], t["ord"], risk.alias("risk"), state.alias("state"), turn.alias("turn"), t["verdict"], F.greatest(t["verdict"], floor_rank(state)).alias("floored"))
        record = F.struct(state, turn, risk, t["ts"], F.array_union(acc["labels"], t["labels"]), scores, t["verdict"], F.concat(acc["out"], F.array(seen.cast(_STEP))))
        return record.cast(_RECORD)

    return step


RECORD = _RECORD


def fresh_record() -> Column:
    """The record of a conversation without turns."""
    return F.struct(F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0), F.array(), F.array(), F.lit(0), F.array()).cast(_RECORD)


def folded(turns: Column, start: Column, half_life_s: float = HALF_LIFE_S, ttl_s: float = TTL_S) -> Column:
    """The record after an array of turns in order; its `out` has a step for each of them.

    A turn that comes the time to live or later after the last one finds a fresh record, so the fold may
    run over a whole conversation or over what is new of it and gives the same.
    """
    advance = _advance(half_life_s)

    def step(acc: Column, t: Column) -> Column:
        over = (acc["turn"] > 0) & (t["ts"] - acc["last"] >= ttl_s)
        return advance(F.when(over, fresh_record().withField("out", acc["out"])).otherwise(acc), t)

    return F.aggregate(turns, start, step)


def turn_column(ts: Column, order: Column, score: Column, verdict: Column, labels: Column, similarity: Column | None = None) -> Column:
    """A turn as the fold takes it: null scores count as 0, null verdicts as allow, null labels as none."""
    return F.struct(
        ts.cast("double").alias("ts"),
        order.cast("string").alias("ord"),
        F.coalesce(score.cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce(verdict.cast("int"), F.lit(0)).alias("verdict"),
        F.coalesce(labels, F.array().cast("array<string>")).alias("labels"),
        (F.lit(None) if similarity is None else similarity).cast("double").alias("similarity"),
    ).cast(_TURN)


_WALKED = "first_key boolean, session int, turn int, risk double, had boolean, before int, scores array<double>, edge int, vector array<float>"
#: Values of `edge`: the first and the last row of a range (both, added up, for a single one).
_FIRST, _LAST = 1, 2


def _walk(batches: Iterator[pa.RecordBatch], half_life_s: float, ttl_s: float) -> Iterator[pa.RecordBatch]:
    """The turns (key, ts, score, verdict, persona, ...) of a range in order, with _WALKED as if no turn came before the range.

    first_key: whether the key is still that of the first row; had: whether an earlier turn of the session set
    a persona; before: the verdict of the turn before; scores: the window of the last scores, this one included.
    Where the turns have a vector, their similarity is that to the turn before of the key, and vectors stay with
    the first and the last turn only.
    """
    key, at, verdict, session, turn, risk, had, first_key = None, 0.0, 0, 0, 0, 0.0, False, True
    tail = np.empty(0)
    vector: np.ndarray | None = None
    held: tuple[pa.RecordBatch, list[pa.Array], np.ndarray, np.ndarray | None] | None = None

    def told(batch: pa.RecordBatch, added: list[pa.Array], edge: np.ndarray, matrix: np.ndarray | None) -> pa.RecordBatch:
        names = [x.split()[0] for x in _WALKED.split(", ")]
        kept = pa.array([matrix[i].astype(np.float32) if matrix is not None and e else None for i, e in enumerate(edge.tolist())], pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([*batch.columns, *added, pa.array(edge), kept], [*batch.schema.names, *names])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, column = batch.column("key"), lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        ts, score, own = column("ts"), column("score"), column("verdict")
        same = np.concatenate([[held is not None and keys[0].as_py() == key], pc.equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)]).astype(bool)
        waited = np.diff(ts, prepend=at)
        fresh = ~same | ~(waited < ttl_s)
        decay = np.power(0.5, np.maximum(0.0, waited) / half_life_s)
        gain = np.maximum(0.0, score - NOISE)
        edge = np.zeros(n, np.int32)
        edge[0] = _FIRST if held is None else 0
        firsts = np.logical_and.accumulate(np.concatenate([[held is None or first_key and same[0]], same[1:]]))
        rows = []
        for goes_on, new, d, g, persona in zip(same.tolist(), fresh.tolist(), decay.tolist(), gain.tolist(), column("persona").tolist()):
            if new:
                session, turn, risk, had = session + 1 if goes_on else 0, 1, g, False
            else:
                turn, risk = turn + 1, risk * d + g
            rows.append((session, turn, risk, had))
            had = had or persona
        sessions_, turns, risks, hads = (np.array(x) for x in zip(*rows))
        before = np.where(fresh, 0, np.concatenate([[verdict], own[:-1]])).astype(np.int32)
        known = np.concatenate([tail, score])
        lengths = np.minimum(turns, WINDOW)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        window = known[np.repeat(np.arange(n) + 1 + len(tail) - offsets[1:], lengths) + np.arange(offsets[-1])]
        scores = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(window))
        matrix = None
        if "vector" in batch.schema.names:
            matrix = _matrix(batch.column("vector"))
            near = np.einsum("ij,ij->i", matrix, np.concatenate([matrix[:1] if vector is None else vector[None], matrix[:-1]]))
            plain = batch.drop_columns(["vector", "similarity"])
            batch = pa.RecordBatch.from_arrays([*plain.columns, pa.array(near, mask=~same)], [*plain.schema.names, "similarity"])
            vector = matrix[-1]
        if held:
            yield told(*held)
        held = batch, [pa.array(firsts), pa.array(sessions_.astype(np.int32)), pa.array(turns.astype(np.int32)), pa.array(risks), pa.array(hads), pa.array(before), scores], edge, matrix
        key, at, verdict, tail, first_key = keys[n - 1].as_py(), ts[-1], own[-1], known[1 - WINDOW :], firsts[-1]
    if held:
        held[2][-1] += _LAST
        yield told(*held)


def _carried(edges: list[Row], half_life_s: float, ttl_s: float) -> list[tuple]:
    """(part, sessions, similarity, at, turn, risk, had, verdict, scores) of every range that goes on with the key of the one before.

    sessions: those before its first one; similarity: of its first turn to the one before, where they have vectors;
    the others are null where its first turn begins a session.
    """
    out = []
    end: Row | None = None
    for first, last in zip((e for e in edges if e.edge & _FIRST), (e for e in edges if e.edge & _LAST)):
        state = last.asDict() | {"had": last.had or last.persona}
        if end and end["key"] == first.key:
            on = first.ts - end["ts"] < ttl_s
            sessions_ = end["session"] + (0 if on else 1)
            near = float(np.dot(np.array(end["vector"], float), np.array(first.vector, float))) if first.vector else None
            out.append((first.part, sessions_, near, *((end[c] for c in ("ts", "turn", "risk", "had", "verdict", "scores")) if on else [None] * 6)))
            if on and last.first_key and last.session == 0:
                risk = state["risk"] + end["risk"] * 0.5 ** (max(0.0, last.ts - end["ts"]) / half_life_s)
                state |= {"turn": last.turn + end["turn"], "risk": risk, "had": state["had"] or end["had"], "scores": [*end["scores"], *last.scores][-WINDOW:]}
            if last.first_key:
                state["session"] += sessions_
        end = state
    return out


def follow(turns: DataFrame, key_col: str, ts_col: str, order_col: str, score_col: str, verdict_col: str, labels_col: str, similarity_col: str | None = None, half_life_s: float = HALF_LIFE_S, ttl_s: float = TTL_S, vector_col: str | None = None) -> DataFrame:
    """(key, session, ts, ord, risk, state, turn, verdict, floored) of every turn with a key.

    Null scores count as 0, null verdicts as allow, null labels as none. Turns without a key belong to no
    conversation and are left out; `ord` breaks ties of time. Turns may come with their similarity to the turn
    before, or with their vector, all of one width, instead.
    """
    kept = turns.where(F.col(key_col).isNotNull() & F.col(ts_col).isNotNull())
    turn = turn_column(F.col(ts_col), F.col(order_col), F.col(score_col), F.col(verdict_col), F.col(labels_col), F.col(similarity_col) if similarity_col else None)
    vector = [F.col(vector_col).cast("array<float>").alias("vector")] if vector_col else []
    given = kept.select(F.col(key_col).alias("key"), turn.alias("t"), *vector).select("key", "t.*", *["vector"] * len(vector))
    placed = ranged(given, ["key", "ts", "ord"], ["score", "verdict", "labels", "similarity"])
    holds = lambda c: F.coalesce(c, F.lit(False))
    persona, escalates = holds(F.array_contains("labels", PERSONA)), holds(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in ESCALATION])))
    plain = placed.select(F.spark_partition_id().alias("part"), "key", "ts", "ord", "score", "verdict", persona.alias("persona"), escalates.alias("escalates"), *["vector"] * len(vector), "similarity")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "vector")
    walked = materialise(plain.mapInArrow(partial(_walk, half_life_s=half_life_s, ttl_s=ttl_s), f"{shape}, {_WALKED}"), "walked")
    edges = walked.where("edge > 0").select("part", "edge", "key", "ts", "first_key", "session", "turn", "risk", "had", "persona", "verdict", "scores", "vector").collect()
    carried = _carried(sorted(edges, key=lambda e: (e.part, e.edge)), half_life_s, ttl_s)
    back = F.broadcast(turns.sparkSession.createDataFrame(carried, "part int, b_sessions int, b_similarity double, b_at double, b_turn int, b_risk double, b_had boolean, b_verdict int, b_scores array<double>"))
    on = F.col("first_key") & (F.col("session") == 0) & F.col("b_turn").isNotNull()
    both = F.concat("b_scores", "scores")
    risk = F.col("risk") + F.col("b_risk") * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.col("ts") - F.col("b_at")) / half_life_s)
    whole = walked.join(back, "part", "left").withColumns({
        "risk": F.when(on, risk).otherwise(F.col("risk")),
        "had": F.col("had") | (on & F.col("b_had")),
        "before": F.when(on & (F.col("turn") == 1), F.col("b_verdict")).otherwise(F.col("before")),
        "scores": F.when(on & (F.col("turn") < WINDOW), F.when(F.size(both) > WINDOW, F.slice(both, -WINDOW, WINDOW)).otherwise(both)).otherwise(F.col("scores")),
        "similarity": F.when(F.col("edge").bitwiseAND(_FIRST) == _FIRST, F.coalesce("similarity", "b_similarity")).otherwise(F.col("similarity")),
        "turn": F.when(on, F.col("turn") + F.col("b_turn")).otherwise(F.col("turn")),
        "session": F.when(F.col("first_key"), F.col("session") + F.coalesce("b_sessions", F.lit(0))).otherwise(F.col("session")),
    })
    pivot = (F.col("before") >= 3) & F.coalesce(F.col("similarity") < PIVOT, F.lit(False))
    state = state_of(F.col("risk"), crescendo(F.col("scores")), F.col("had") & F.col("escalates"), pivot, F.col("had") | F.col("persona"))
    return whole.withColumn("state", state).select("key", "session", "ts", "ord", "risk", "state", "turn", "verdict", F.greatest("verdict", floor_rank(F.col("state"))).alias("floored"))


def named(df: DataFrame) -> DataFrame:
    """State and verdicts by name."""
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) + 1)
    return df.withColumns({"state": pick(STATES, "state"), "verdict": pick(VERDICTS, "verdict"), "floored": pick(VERDICTS, "floored")})


def record_json(record: Column) -> Column:
    """A conversation record as JSON with sorted labels and without its steps, as a state store keeps it."""
    return F.to_json(record.withField("labels", F.array_sort(record["labels"])).dropFields("out"))


def record_from_json(text: Column) -> Column:
    """The record that record_json wrote; a fresh one for null or what is none."""
    read = F.from_json(text, _RECORD)
    whole = read["turn"].isNotNull() & read["labels"].isNotNull() & read["scores"].isNotNull()
    return F.when(whole, read.withField("out", F.array().cast(f"array<{_STEP}>"))).otherwise(fresh_record())
