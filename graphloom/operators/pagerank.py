"""PageRank by synchronous pulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.materialize import discard, materialize


def pagerank(graph: Graph, most_rounds: int = 20, tolerance: float = 1e-4, damping: float = 0.85) -> DataFrame:
    """``id, score``.  Scores start at 1 / n; what vertices without out-arcs hold is dropped, not shared out.

    Stops when scores change by less than ``tolerance`` in sum, which is looked at once a round; a tolerance of 0
    always takes ``most_rounds`` rounds and writes every fourth.
    """
    n = max(graph.nodes, 1)
    out = graph.out_degrees()
    state = materialize(out.select("id", "degree", F.lit(1.0 / n).alias("score")), "rank")
    written = state
    for i in range(most_rounds):
        share = state.where("degree > 0").select("id", (F.col("score") / F.col("degree")).alias("share"))
        sums = share.join(graph.by_src(), F.col("id") == F.col("src")).groupBy("dst").agg(F.sum("share").alias("sum"))
        new = state.join(sums, state["id"] == sums["dst"], "left").select("id", "degree", (F.lit((1 - damping) / n) + damping * F.coalesce("sum", F.lit(0.0))).alias("score"), F.col("score").alias("old"))
        if tolerance <= 0 and i % 4 != 3 and i < most_rounds - 1:
            state = new.drop("old")
            continue
        new = materialize(new, "rank")
        discard(written)
        state, written = new.drop("old"), new
        if tolerance > 0 and new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).head()[0] < tolerance:
            break
    return state.select("id", "score")


def top_scores(scores: DataFrame, k: int = 5, value: str = "score", key: str = "id") -> DataFrame:
    """The ``k`` largest values, of equal ones the larger key first."""
    return scores.orderBy(F.desc(value), F.desc(key)).limit(k)
