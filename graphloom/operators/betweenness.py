"""Betweenness centrality from sampled sources (Brandes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.materialize import discard, materialize


def path_counts(graph: Graph, sources: DataFrame) -> list[DataFrame]:
    """Breadth-first levels (source, id, paths) from all sources at once; ``paths`` counts shortest paths."""
    level = materialize(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")), "level")
    levels = [level]
    while True:
        met = level.join(graph.by_src(), F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        for old in levels:
            met = met.join(old.select("source", "id"), ["source", "id"], "left_anti")
        level = materialize(met, "level")
        if not level.head(1):
            discard(level)
            return levels
        levels.append(level)


def betweenness(graph: Graph, sources: DataFrame, normalized: bool = True) -> DataFrame:
    """``id, score`` for every vertex, summed over ``sources`` (id); a source's own dependency counts.

    Scores are divided by the largest; where all are 0 they stay so.
    """
    levels = path_counts(graph, sources)
    below = levels[-1].select("source", "id", "paths", F.lit(0.0).alias("share"))
    shares = [below]
    for level in reversed(levels[:-1]):
        child = below.select(F.col("source").alias("_s"), F.col("id").alias("_c"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        arcs = level.join(graph.by_src(), F.col("id") == F.col("src")).select("source", "id", "dst")
        got = arcs.join(child, (arcs["source"] == child["_s"]) & (arcs["dst"] == child["_c"])).groupBy("source", "id").agg(F.sum("part").alias("part"))
        below = materialize(level.join(got, ["source", "id"], "left").select("source", "id", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")), "shares")
        shares.append(below)
    total = shares[0]
    for x in shares[1:]:
        total = total.unionByName(x)
    sums = materialize(graph.vertices().join(total.groupBy("id").agg(F.sum("share").alias("score")), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score")), "scores")
    most = sums.agg(F.max("score")).head()[0] or 0.0
    return sums.select("id", (F.col("score") / most).alias("score")) if normalized and most > 0 else sums
