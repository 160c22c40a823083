"""Breadth-first search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.materialize import materialize, materialize_watched


@dataclass
class Direction:
    """Whether a superstep pushes from its frontier or pulls into what is not reached yet.

    It turns to pulling when the frontier's arcs are more than 1 / ``alpha`` of those that leave unreached vertices, and
    back to pushing when the frontier shrinks and holds less than 1 / ``beta`` of all vertices.
    """

    nodes: int
    alpha: int = 15
    beta: int = 18
    pulls: bool = False
    last: int = 0

    def choose(self, size: int, arcs: int, unseen: int) -> str:
        if not self.pulls:
            self.pulls = arcs * self.alpha > unseen
        elif size < self.last and size * self.beta < self.nodes:
            self.pulls = False
        self.last = size
        return "bottom_up" if self.pulls else "top_down"


def push(graph: Graph, level: DataFrame, seen: DataFrame) -> DataFrame:
    """(dst, parent) of the vertices not seen that arcs of ``level`` lead to."""
    met = level.select("id").join(graph.by_src(), F.col("id") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent"))
    return met.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")


def pull(graph: Graph, level: DataFrame, seen: DataFrame) -> DataFrame:
    """The same from the other end: only arcs into vertices not seen are read on."""
    open_ = graph.by_dst().join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
    return open_.join(level.select(F.col("id").alias("src")), "src", "left_semi").groupBy("dst").agg(F.min("src").alias("parent"))


def bfs(graph: Graph, source: int, strategy: str = "top_down", most_depth: int | None = None, alpha: int = 15, beta: int = 18, trace: list[dict] | None = None) -> DataFrame:
    """``id, depth, parent`` of the vertices reached; of several possible parents the smallest id.

    ``top_down`` joins the frontier with its arcs.  ``bottom_up`` starts from the vertices not reached yet and
    looks for a neighbour in the frontier, which reads less once most vertices are reached.  ``hybrid`` chooses between
    them before each superstep (see ``Direction``); sizes and arcs of a frontier are summed up while it is written, so
    the choice costs no job.  Levels are tables of their own, so what a superstep writes is its frontier and not the
    whole state.  ``trace`` gets a row for each superstep: ``depth, direction, size, arcs, unseen``.
    """
    degrees = graph.degree_table() if strategy == "hybrid" else None
    turn = Direction(graph.nodes, alpha, beta)
    unseen = graph.arcs() if degrees is not None else 0

    def written(found: DataFrame) -> tuple[DataFrame, int, int]:
        if degrees is None:
            table, state = materialize_watched(found, "level", size=F.count(F.lit(1)))
            return table, state["size"], 0
        table, state = materialize_watched(found.join(degrees, "id", "left").select(*found.columns, F.coalesce("degree", F.lit(0)).alias("degree")), "level", size=F.count(F.lit(1)), arcs=F.sum("degree"))
        return table.drop("degree"), state["size"], state["arcs"] or 0

    level, size, arcs = written(graph.vertices().where(F.col("id") == source).select("id", F.lit(0).cast("long").alias("depth"), F.col("id").alias("parent")))
    levels, seen, depth = [level], level, 0
    while size and (most_depth is None or depth < most_depth):
        depth += 1
        unseen -= arcs
        way = turn.choose(size, arcs, unseen) if degrees is not None else strategy
        if trace is not None:
            trace.append({"depth": depth, "direction": way, "size": size, "arcs": arcs, "unseen": unseen})
        found = {"top_down": push, "bottom_up": pull}[way](graph, level, seen)
        level, size, arcs = written(found.select(F.col("dst").alias("id"), F.lit(depth).cast("long").alias("depth"), "parent"))
        if not size:
            break
        levels.append(level)
        if len(levels) % 16 == 0:
            levels = [materialize(reduce(DataFrame.unionByName, levels), "seen")]
        seen = reduce(DataFrame.unionByName, levels)
    return seen


def bfs_all(graph: Graph, source: int, **how) -> DataFrame:
    """All vertices, with -1 as parent and null as depth where they are not reached."""
    return graph.vertices().join(bfs(graph, source, **how), "id", "left").select("id", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"))


def bfs_stats(graph: Graph, tree: DataFrame) -> DataFrame:
    """``reached`` vertices and the ``arcs`` that leave them."""
    return tree.join(graph.out_degrees(), "id").agg(F.count(F.lit(1)).alias("reached"), F.sum("degree").alias("arcs"))
