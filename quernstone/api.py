"""One object for programs that screen texts by calls instead of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import egress
from quernstone.operators.embedding import Models
from quernstone.operators.scoring import CUTS, Cuts
from quernstone.plans import detect as plan

#: Texts of one call.
MOST_TEXTS = 256


@dataclass(frozen=True)
class Screen:
    """Screens texts, chats and outgoing texts on a session.

    Every call is one job over a small table; whole tables go to the plans themselves.
    """

    spark: SparkSession
    models: Models | None = None
    cuts: Cuts = field(default_factory=lambda: Cuts(*CUTS))

    def decide(self, texts: list[str], scope: str = "user", shadow: bool = False) -> list[Row]:
        """The decision on each text, in their order; raises for an empty call, one too large or a text that is not acceptable."""
        if not 0 < len(texts) <= MOST_TEXTS:
            raise ValueError(f"a call takes 1 to {MOST_TEXTS} texts")
        rows = [(f"{i:03}", t, scope, shadow) for i, t in enumerate(texts)]
        df = self.spark.createDataFrame(rows, "request_id string, text string, scope string, shadow boolean")
        out = {r.id: r for r in plan.detect(df, shadow_col="shadow", models=self.models, cuts=self.cuts).collect()}
        if bad := [i for i, *_ in rows if i not in out]:
            raise ValueError(f"text {int(bad[0])} is empty or too long")
        return [out[i] for i, *_ in rows]

    def conversation(self, texts: list[str], seconds_apart: float = 1.0) -> list[Row]:
        """The decisions on the turns of one conversation, raised to what it asks for."""
        rows = [(f"{i:03}", t, "user", "c", i * seconds_apart) for i, t in enumerate(texts)]
        df = self.spark.createDataFrame(rows, "request_id string, text string, scope string, conversation_id string, received_at double")
        return plan.screen_conversations(df, self.models).orderBy("id").collect()

    def outgoing(self, texts: list[str]) -> list[Row]:
        """(text, findings, redacted) of texts on their way out."""
        df = self.spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        return egress.inspect(df, "text").orderBy("i").select("text", "findings", "redacted").collect()

    @staticmethod
    def recent(decisions: DataFrame, most: int = 500) -> DataFrame:
        """The newest decisions of a log, once each."""
        return decisions.dropDuplicates(["id"]).orderBy(F.desc("ts"), F.desc("id")).limit(most)
