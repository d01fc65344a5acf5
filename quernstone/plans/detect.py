"""Whole plans: the decision on a text, on a chat, on outgoing text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.normalise import normalise
from quernstone.operators import egress, rules as R
from quernstone.operators.conversation import STATES, follow
from quernstone.operators.embedding import Models, layer_scores
from quernstone.operators.rules.gate import gate
from quernstone.operators.scoring import CUTS, Cuts, Weights, contributions, decide, fuse, verdict_name, verdict_of
from quernstone.plans.runtime import materialise, spread

#: Weights of a fit on labelled validation rows; a fit of one's own takes their place.
WEIGHTS = Weights(-4.4484, {"l0": 0.0090, "l1": 2.2509, "l2": 6.4159, "knn": 1.5783})
REQUEST_CHARS = (1, 100_000)


def acceptable(text: Column) -> Column:
    """Whether a request has from 1 to 100,000 characters; the others are turned away."""
    return F.coalesce(F.length(text).between(*REQUEST_CHARS), F.lit(False))


def matched(df: DataFrame, text_col: str, scope_col: str, rules: list[R.Rule] | None = None) -> DataFrame:
    """df with l0 (the report) and matches: per rule the first view that fires, heaviest first, spans in the original text."""
    rules = rules or R.shipped_rules()
    trees = [r.match for r in rules]
    report = normalise(spread(df), text_col, gate=lambda: gate(trees))
    scoped = report.withColumn("__scope", F.coalesce(F.col(scope_col), F.lit("user")))
    return scoped.withColumn("matches", R.report_matches(rules, "l0.views", "__scope")).drop("__scope")


def detect(df: DataFrame, id_col: str = "request_id", text_col: str = "text", scope_col: str = "scope", shadow_col: str | None = None, rules: list[R.Rule] | None = None, weights: Weights = WEIGHTS, cuts: Cuts = Cuts(*CUTS), l2_col: str | None = None, knn_col: str | None = None, models: Models | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, l0, l1, l2, knn, score, contributions, labels, matches, verdict, enforced, rationale) of every acceptable text.

    The classifier's and the index's scores come from `models`, or are columns of `df`; without either these
    layers count 0. The decision is made within the row unless the index is too large to send around.
    `keep` names columns of `df`, or `vector`, that stay beside it. `rejected` has the texts that are turned away.
    """
    kept = df.where(acceptable(F.col(text_col)))
    if models:
        kept = layer_scores(spread(kept), id_col, text_col, models, "vector" in keep)
        l2_col, knn_col = "l2", "knn"
    m = matched(kept, text_col, scope_col, rules)
    none = F.array().cast("array<double>")
    scored = m.select(
        F.col(id_col).alias("id"),
        F.col(shadow_col).alias("shadow") if shadow_col else F.lit(False).alias("shadow"),
        F.col("l0.score").alias("l0"),
        R.noisy_or(F.coalesce(F.transform("matches", lambda x: x["weight"]), none)).alias("l1"),
        (F.col(l2_col) if l2_col else F.lit(0.0)).alias("l2"),
        (F.col(knn_col) if knn_col else F.lit(0.0)).alias("knn"),
        F.coalesce(R.label_set(F.transform("matches", lambda x: x["labels"])), F.array().cast("array<string>")).alias("labels"),
        "matches",
        *keep,
    )
    return decide(scored.withColumns({"score": fuse(weights), "contributions": contributions(weights)}), "score", "shadow", cuts).drop("shadow")


def rejected(df: DataFrame, id_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """(id, reason) of the requests that `detect` turns away."""
    length = F.length(F.col(text_col))
    reason = F.when(length.isNull(), "no text").when(length < REQUEST_CHARS[0], "empty text").when(length > REQUEST_CHARS[1], "text too long")
    return df.where(~acceptable(F.col(text_col))).select(F.col(id_col).alias("id"), reason.alias("reason"))


def rejected_batches(requests: DataFrame, batch_col: str, most: int = 256) -> DataFrame:
    """(batch, texts) of the batches with more texts than one call may have."""
    return requests.groupBy(F.col(batch_col).alias("batch")).agg(F.count("*").alias("texts")).where(F.col("texts") > most)


def screen_conversations(df: DataFrame, models: Models | None = None, id_col: str = "request_id", text_col: str = "text", scope_col: str = "scope", key_col: str = "conversation_id", at_col: str = "received_at", shadow_col: str | None = None) -> DataFrame:
    """(id, key, verdict, state, turn, risk, floored, enforced, rationale): decisions raised to what their conversation asks for.

    Every acceptable turn is decided by itself; the verdicts before the floor, the labels and the similarity
    to the turn before then run through the fold of its conversation. Turns without a key keep their verdict.
    """
    at = F.col(at_col).cast("timestamp").cast("double") if df.schema[at_col].dataType.typeName().startswith("timestamp") else F.col(at_col).cast("double")
    shaped = df.withColumns({"_key": F.col(key_col), "_at": at})
    keep = ("_key", "_at", "vector") if models else ("_key", "_at")
    alone = materialise(detect(shaped, id_col, text_col, scope_col, shadow_col, models=models, keep=keep).select("id", "score", "labels", "verdict", "enforced", "rationale", *keep), "decided")
    turns = alone.where("_key IS NOT NULL AND _at IS NOT NULL").withColumn("_rank", verdict_of(F.col("verdict")))
    told = follow(turns, "_key", "_at", "id", "score", "_rank", "labels", vector_col="vector" if models else None).select(F.col("key"), F.col("ord"), "turn", "risk", "state", "floored")
    joined = alone.join(told, (F.col("_key") == F.col("key")) & (F.col("id").cast("string") == F.col("ord")), "left")
    rank = F.coalesce("floored", verdict_of(F.col("verdict")))
    raised = rank > verdict_of(F.col("verdict"))
    state = F.when(F.col("ord").isNotNull(), F.element_at(F.array(*[F.lit(x) for x in STATES]), F.col("state") + 1))
    shadow = ~F.col("enforced")
    return joined.select("id", F.col("_key").alias("key"), "verdict", state.alias("state"), "turn", "risk", verdict_name(rank).alias("floored"), (~shadow).alias("enforced"), F.when(raised, F.concat("rationale", F.lit("; raised by conversation state "), state)).otherwise(F.col("rationale")).alias("rationale"))


def last_user_text(messages: Column) -> Column:
    """Content of the last message of the user, an empty text without one."""
    own = F.filter(messages, lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(own, F.lit(-1))["content"], F.lit(""))


def screen_chat(chats: DataFrame, id_col: str, messages_col: str, secret: str) -> DataFrame:
    """(id, blocked, verdict, score, messages): chats with the canary put in; enforced blocks have no messages."""
    asked = chats.select(F.col(id_col).alias("_chat"), messages_col, last_user_text(F.col(messages_col)).alias("_text"), F.lit("user").alias("_scope"))
    found = detect(asked, "_chat", "_text", "_scope").select("id", "verdict", "score", "enforced")
    joined = asked.join(found, F.col("_chat") == F.col("id"), "left")
    blocked = F.coalesce((F.col("verdict") == "block") & F.col("enforced"), F.lit(False))
    sentinel = egress.canary(secret, F.col("_chat"))
    return joined.select(F.col("_chat").alias("id"), blocked.alias("blocked"), "verdict", "score", F.when(~blocked, egress.with_canary(F.col(messages_col), sentinel)).alias("messages"), sentinel.alias("canary"))
