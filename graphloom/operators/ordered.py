"""Ordered processing by priority buckets; shortest paths of all kinds are instances."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.materialize import discard, materialize, materialize_watched

#: Stands for "not reached" where a number is wanted.
UNREACHED = (1 << 31) // 2 - 1


@dataclass
class Progress:
    """What is known when a superstep begins."""

    waiting: int = 0  #: vertices that wait
    low: int | None = None  #: the least key among them
    watched: dict[str, Any] = field(default_factory=dict)  #: the least so far of each expression that is watched

    def take(self, seen: dict) -> None:
        self.waiting, self.low = seen.pop("_waiting"), seen.pop("_low")
        for name, value in seen.items():
            old = self.watched.get(name)
            self.watched[name] = value if old is None or (value is not None and value < old) else old


def fused_rounds(waiting: int, growth: float, most_arcs: int, most: int = 8) -> int:
    """How many relaxations go into one superstep: as many as are expected to touch ``most_arcs`` arcs in all."""
    room = math.log(max(most_arcs, 1) / max(waiting, 1)) / math.log(max(growth, 2.0))
    return max(1, min(most, math.floor(room)))


def ordered_process(
    graph: Graph,
    start: DataFrame,
    relax: Callable[[Column, Column], Column] = lambda value, weight: value + weight,
    key: Callable[[Column, Column], Column] | None = None,
    hints: DataFrame | None = None,
    delta: int | None = None,
    merge_buckets: int = 1,
    rounds: int | str = 1,
    watch: dict[str, Column] | None = None,
    stop: Callable[[Progress], bool] | None = None,
    extend: Callable[[Progress], Column] | None = None,
    fuse_arcs: int = 100_000,
    trace: list[dict] | None = None,
) -> DataFrame:
    """``id, value`` for the least values reachable from ``start`` (id, value).

    Each superstep takes the waiting vertices of the lowest bucket (``key // delta``; without ``delta`` all that
    wait, which needs the fewest jobs), relaxes their arcs and keeps improvements.  The result does not depend on
    ``delta``, ``merge_buckets`` (how many buckets go at once) or ``rounds`` (how often arcs are relaxed before a
    superstep is written; ``auto``: as many times as are expected to touch ``fuse_arcs`` arcs, from the number of
    vertices that wait and the arcs of a vertex).  ``key`` makes a priority of a value and the vertex's ``hint`` (from
    ``hints``: id, hint); the default is the value.

    ``watch`` names expressions over the waiting rows (id, value, key), of which the least so far is known before each superstep;
    they are taken while the superstep is written and cost no job.  ``stop`` ends the search when it says so of the
    progress, ``extend`` makes of it a condition on the rows that are worth extending.  Rows that fail it when their bucket
    has its turn are settled as they are.  Values must not fall along arcs.

    A superstep writes the vertices that wait after it, not all that are known.  New values, old ones and the waiting
    meet in a single exchange by vertex, after partial minima; arcs stay where they are.  Every eight supersteps the
    tables written so far are merged.  ``trace`` gets a row for each superstep: ``waiting, low, rounds``.
    """
    key = key or (lambda value, hint: value)
    none, watch = F.lit(None).cast("long"), watch or {}
    growth = graph.arcs() / max(graph.nodes, 1) if rounds == "auto" else 0.0
    aggregates = {"_waiting": F.count_if("waits"), "_low": F.min(F.when(F.col("waits"), F.col("key")))} | {n: F.min(F.when(F.col("waits"), c)) for n, c in watch.items()}

    def keyed(rows: DataFrame) -> DataFrame:
        if hints is None:
            return rows.withColumn("key", key(F.col("value"), F.lit(0)).cast("long"))
        h = hints.select(F.col("id").alias("_h"), "hint")
        return rows.join(h, rows["id"] == h["_h"], "left").withColumn("key", key(F.col("value"), F.coalesce("hint", F.lit(0))).cast("long")).drop("_h", "hint")

    def improved(active: DataFrame, known: list[DataFrame]) -> DataFrame:
        """(id, value) of what the arcs of ``active`` lead to, where that is less than what is known."""
        reached = active.select(F.col("id").alias("_id"), "value").join(graph.by_src(), F.col("_id") == F.col("src")).select(F.col("dst").alias("id"), relax(F.col("value"), F.col("weight")).cast("long").alias("new"))
        parts = [reached.withColumn("old", none), *[t.select("id", none.alias("new"), F.col("value").alias("old")) for t in known]]
        met = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min("new").alias("new"), F.min("old").alias("old"))
        # ids are never null: said here, or the join of the next round says it for itself alone, and its exchange is then another one
        return met.where(F.col("id").isNotNull() & F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))).select("id", F.col("new").alias("value"))

    progress = Progress()
    table, seen = materialize_watched(keyed(start.select("id", F.col("value").cast("long").alias("value"), F.lit(True).alias("waits"))), "waiting", **aggregates)
    progress.take(seen)
    known = [table]
    while progress.waiting and not (stop and stop(progress)):
        waiting = table.where("waits").drop("waits")
        turn = F.expr(f"key div {delta}") < progress.low // delta + merge_buckets if delta else F.lit(True)
        worth = extend(progress) if extend else F.lit(True)
        n = fused_rounds(progress.waiting, growth, fuse_arcs) if rounds == "auto" else rounds
        if trace is not None:
            trace.append({"waiting": progress.waiting, "low": progress.low, "rounds": n})
        active, found = waiting.where(turn & worth), []
        for i in range(n):
            # a chain: each round reads the one before it once, and what was known before the superstep
            found.append(improved(active, known))
            if i + 1 < n:
                active = keyed(found[-1]).where(worth) if extend else found[-1]
        if n == 1 and not delta:
            after = found[0].withColumn("waits", F.lit(True))
        else:
            # what an earlier round found and no later one bettered has been extended; only the last round's waits, and other buckets
            parts = [f.select("id", "value", (F.col("value") if i + 1 < n else none).alias("done"), none.alias("rest")) for i, f in enumerate(found)]
            if delta:
                parts.append(waiting.where(~turn).select("id", none.alias("value"), none.alias("done"), F.col("value").alias("rest")))
            met = reduce(DataFrame.unionByName, parts).groupBy("id").agg(*[F.min(c).alias(c) for c in ("value", "done", "rest")])
            waits = F.when(F.col("value").isNull(), True).otherwise(F.col("done").isNull() | (F.col("value") < F.col("done")))
            after = met.select("id", F.coalesce("value", "rest").alias("value"), waits.alias("waits"))
        table, seen = materialize_watched(keyed(after), "waiting", **aggregates)
        progress.take(seen)
        known.append(table)
        if len(known) >= 8:
            merged = materialize(reduce(DataFrame.unionByName, [t.select("id", "value") for t in known]).groupBy("id").agg(F.min("value").alias("value")), "known")
            discard(*known[:-1])
            known = [merged, table]
    return reduce(DataFrame.unionByName, [t.select("id", "value") for t in known]).groupBy("id").agg(F.min("value").alias("value"))


def fill_sentinels(graph: Graph, values: DataFrame, missing: int = UNREACHED) -> DataFrame:
    """All vertices, with ``missing`` where a value is not known."""
    return graph.vertices().join(values, "id", "left").select("id", F.coalesce("value", F.lit(missing)).alias("value"))


def _from(graph: Graph, source: int) -> DataFrame:
    return graph.vertices().where(F.col("id") == source).select("id", F.lit(0).cast("long").alias("value"))


def sssp(graph: Graph, source: int, delta: int | None = None, merge_buckets: int = 1, rounds: int | str = 1, trace: list[dict] | None = None) -> DataFrame:
    """``id, dist`` of the vertices that ``source`` reaches; weights must not be negative."""
    return ordered_process(graph, _from(graph, source), delta=delta, merge_buckets=merge_buckets, rounds=rounds, trace=trace).withColumnRenamed("value", "dist")


def towards(dest: int) -> dict[str, Any]:
    """``watch``, ``stop`` and ``extend`` of a search that is over once no key that waits is below that of ``dest``."""
    goal = lambda p: p.watched.get("goal")
    return {
        "watch": {"goal": F.when(F.col("id") == dest, F.col("key"))},
        "stop": lambda p: goal(p) is not None and p.low >= goal(p),
        "extend": lambda p: F.lit(True) if goal(p) is None else F.col("key") < goal(p),
    }


def search(graph: Graph, source: int, dest: int, estimates: DataFrame | None = None, delta: int | None = None, rounds: int | str = 1, trace: list[dict] | None = None) -> DataFrame:
    """``id, dist`` of all that a search for ``dest`` has met: final for ``dest`` and what is nearer, upper bounds beyond."""
    how = {} if estimates is None else {"key": lambda value, hint: value + hint, "hints": estimates}
    return ordered_process(graph, _from(graph, source), delta=delta, rounds=rounds, trace=trace, **how, **towards(dest)).withColumnRenamed("value", "dist")


def ppsp(graph: Graph, source: int, dest: int, delta: int | None = None, rounds: int | str = 1, trace: list[dict] | None = None) -> DataFrame:
    """``id, dist`` for ``dest`` alone: no row where it is not reached."""
    return search(graph, source, dest, None, delta, rounds, trace).where(F.col("id") == dest)


def astar(graph: Graph, source: int, dest: int, estimates: DataFrame, delta: int | None = None, rounds: int | str = 1, trace: list[dict] | None = None) -> DataFrame:
    """``ppsp`` in the order of distance plus an estimate (id, hint) that must not exceed the way to ``dest``."""
    return search(graph, source, dest, estimates, delta, rounds, trace).where(F.col("id") == dest)
