"""Generic frontier algebra: maps over the arcs and vertices of a vertex subset.

A subset is a DataFrame with a column ``id`` (and properties, if any).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph


def edge_map(
    graph: Graph, frontier: DataFrame, update: Callable[[DataFrame], Column] | None = None, combine: Callable[[Column], Column] = F.min, cond: DataFrame | None = None,
    direction: str = "push", threshold: int | None = None, trace: list[dict] | None = None,
) -> DataFrame:
    """Targets of the frontier's arcs with a combined value: ``id, value``.

    ``update`` makes a value of a joined row (the frontier's columns, dst, weight; default: the source id),
    ``combine`` aggregates the values that meet in a target, ``cond`` keeps only targets among its ids.

    ``push`` joins the frontier with the arcs that leave it.  ``pull`` begins at the arcs into targets that ``cond`` lets
    through, which lie together by target, and joins the frontier to those.  ``auto`` pulls when the frontier's vertices and arcs
    together are more than ``threshold`` (a twentieth of all arcs), for which it counts them in one job first.
    """
    way = direction
    if direction == "auto":
        limit = graph.arcs() // 20 if threshold is None else threshold
        size, arcs = frontier.select("id").join(graph.degree_table(), "id", "left").agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0))).head()
        way = "pull" if size + arcs > limit else "push"
        if trace is not None:
            trace.append({"direction": way, "size": size, "arcs": arcs, "threshold": limit})
    arcs = graph.by_dst() if way == "pull" else graph.by_src()
    if cond is not None and way == "pull":
        arcs = arcs.join(cond.select(F.col("id").alias("dst")), "dst", "left_semi")
    met = frontier.join(arcs, frontier["id"] == F.col("src"))
    if cond is not None and way != "pull":
        met = met.join(cond.select(F.col("id").alias("dst")), "dst", "left_semi")
    value = update(met) if update else met["src"]
    return met.select(met["dst"].alias("id"), value.alias("value")).groupBy("id").agg(combine(F.col("value")).alias("value"))


def vertex_map(subset: DataFrame, **columns: Column) -> DataFrame:
    """``subset`` with new or changed properties."""
    return subset.withColumns(columns)


def vertex_filter(subset: DataFrame, predicate: Column) -> DataFrame:
    return subset.where(predicate)


def size(subset: DataFrame) -> int:
    return subset.count()


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two subsets hold the same ids."""
    x, y = a.select("id").distinct(), b.select("id").distinct()
    return not x.join(y, "id", "left_anti").head(1) and not y.join(x, "id", "left_anti").head(1)


def run_rounds(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int | None = None) -> DataFrame:
    """Apply ``step`` to a frontier until it is empty, or ``rounds`` times; the last frontier that was not empty."""
    from graphloom.plans.materialize import discard, materialize

    current, i = materialize(start, "frontier"), 0
    while rounds is None or i < rounds:
        following = materialize(step(current, i), "frontier")
        if not following.head(1):
            discard(following)
            break
        discard(current)
        current, i = following, i + 1
    return current
