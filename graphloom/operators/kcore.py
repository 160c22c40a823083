"""k-core decomposition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, bucket_number
from graphloom.plans.materialize import discard, materialize_bucketed, materialize_watched

#: Kinds of rows of a bucket, and a value above all degrees.
STATE, CHANGES, MOST = 0, 1, (1 << 31) - 1


def _packed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _unpacked(data: pa.Scalar, n: int) -> np.ndarray:
    data = data.as_buffer()
    return np.frombuffer(data, f"u{len(data) // max(n, 1) or 1}")


def _rows(bucket: int, moved: int, core: np.ndarray, wide: np.ndarray, counts: np.ndarray, told: np.ndarray, old: np.ndarray, new: np.ndarray, buckets: int) -> pa.Table:
    """The state of a bucket as a row, and a row for each bucket that is told what has changed from ``old`` to ``new``."""
    to = (told % buckets).astype(np.min_scalar_type(buckets))
    order, each = np.argsort(to, kind="stable"), np.bincount(to, minlength=buckets)
    some = np.flatnonzero(each)
    columns = {"bucket": [[bucket], some], "kind": [[STATE], np.full(len(some), CHANGES)], "n": [[len(core)], each[some]], "cells": [[len(counts)], np.zeros(len(some))], "moved": [[moved], np.zeros(len(some))]}
    out = {c: pa.array(np.concatenate(parts).astype(np.int64)) for c, parts in columns.items()}
    for name, mine, sent in (("x", _packed(core), told // buckets), ("y", _packed(wide), old), ("z", counts, new)):
        sent = _packed(sent)[order]
        ends = np.cumsum(np.concatenate([[0, mine.nbytes], each[some] * sent.itemsize])).astype(np.int64)
        out[name] = pa.Array.from_buffers(pa.large_binary(), len(some) + 1, [None, pa.py_buffer(ends), pa.py_buffer(mine.tobytes() + sent.tobytes())]).cast(pa.binary())
    return pa.table(out)


def _begun(buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Each vertex has its degree, takes its neighbours to have as much, and tells them."""

    def begin(key: tuple, _: pa.Table, lists: pa.Table) -> pa.Table:
        n = lists["n"][0].as_py()
        core, sizes, ends = (_unpacked(lists[c][0], m).astype(np.int64) for c, m in (("degree", n), ("size", n), ("ends", lists["arcs"][0].as_py())))
        # no count is ever above the degree, so this type holds them all
        counts = np.zeros(int(core.sum()) + n, _packed(core).dtype)
        counts[np.cumsum(core + 1) - 1] = core
        return _rows(key[0].as_py(), n, core, core + 1, counts, ends, np.full(len(ends), MOST), np.repeat(core, sizes), buckets)

    return begin


def _ragged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of ranges laid one after the other: where each is, and its number in its range."""
    number = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(start, length) + number, number


def _step(buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Counts of neighbours by value (what is above a vertex's own counts as that) take in what has changed; vertices with too
    few of their own value fall to the most that enough of them have, and tell their neighbours."""

    def step(key: tuple, rows: pa.Table, lists: pa.Table) -> pa.Table:
        kinds, sizes, cells = (rows[c].to_numpy() for c in ("kind", "n", "cells"))
        at = int(np.flatnonzero(kinds == STATE)[0])
        n = int(sizes[at])
        core, wide = (_unpacked(rows[c][at], n).astype(np.int64) for c in "xy")
        counts = _unpacked(rows["z"][at], int(cells[at]))
        changes, none = np.flatnonzero(kinds == CHANGES), core[:0]
        if not len(changes):
            return _rows(key[0].as_py(), 0, core, wide, counts, none, none, none, buckets)
        told, old, new = (np.concatenate([_unpacked(rows[c][int(i)], int(sizes[i])) for i in changes]).astype(np.int64) for c in "xyz")
        counts, start = counts.copy(), np.cumsum(wide) - wide
        met = np.flatnonzero(np.bincount(told, minlength=n))
        own, place = core[met], np.zeros(n, np.int64)
        first = np.cumsum(own + 1) - own - 1
        place[met] = first
        cell, value = _ragged(start[met], own + 1)
        now = counts[cell] + np.bincount(place[told] + np.minimum(new, core[told]), minlength=len(cell)) - np.bincount(place[told] + np.minimum(old, core[told]), minlength=len(cell))
        upto = np.cumsum(now)
        atleast = np.repeat(upto[first + own], own + 1) - upto + now
        h = np.maximum.reduceat(np.where(atleast >= value, value, 0), first)
        low = np.repeat(h, own + 1)
        counts[cell] = np.where(value < low, now, np.where(value == low, atleast, 0))
        fell = h < own
        moved, own, fallen = met[fell], own[fell], h[fell]
        core[moved] = fallen
        if len(counts) > 2 * (core.sum() + n):
            kept, _ = _ragged(start, core + 1)
            counts, wide = counts[kept], core + 1
        if not len(moved):
            return _rows(key[0].as_py(), 0, core, wide, counts, none, none, none, buckets)
        sizes = _unpacked(lists["size"][0], n).astype(np.int64)
        mine, _ = _ragged((np.cumsum(sizes) - sizes)[moved], sizes[moved])
        told = _unpacked(lists["ends"][0], lists["arcs"][0].as_py())[mine].astype(np.int64)
        return _rows(key[0].as_py(), len(moved), core, wide, counts, told, np.repeat(own, sizes[moved]), np.repeat(fallen, sizes[moved]), buckets)

    return step


def _listed(buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A bucket's degrees and lists of neighbours in one row; its vertices lie ``buckets`` apart."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        ends = rows["ends"].combine_chunks()
        flat, sizes = _packed(ends.flatten().to_numpy()), _packed(np.diff(ends.offsets.to_numpy()))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "n": [len(rows)], "arcs": [len(flat)], "degree": [_packed(rows["degree"].to_numpy()).tobytes()], "size": [sizes.tobytes()], "ends": [flat.tobytes()]})

    return pack


def _cores(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n = batch["n"][i].as_py()
                yield pa.RecordBatch.from_pydict({"id": np.arange(n) * buckets + batch["bucket"][i].as_py(), "coreness": _unpacked(batch["x"][i], n).astype(np.int64)})

    return run


def _hindex(graph: Graph, rounds: int = 8) -> DataFrame:
    """The fixed point of "as many neighbours as that have at least that much", from the degrees down.

    Buckets of vertices keep how many neighbours of a vertex have which value, and only vertices that fall tell their
    neighbours, so that a round exchanges what has changed and not what is known.  ``rounds`` go into each table written;
    rounds after the fixed point change nothing.
    """
    parts = graph.buckets or bucket_number(graph.spark, graph.arcs())
    buckets = max(1, min(parts, graph.nodes))
    lists = graph.by_dst().groupBy(F.col("dst").alias("id")).agg(F.collect_list("src").alias("ends"))
    known = graph.out_degrees().join(lists, "id", "left").select((F.col("id") % buckets).alias("bucket"), "id", "degree", F.coalesce("ends", F.array().cast("array<long>")).alias("ends"))
    packed = known.groupBy("bucket").applyInArrow(_listed(buckets), "bucket long, n long, arcs long, degree binary, size binary, ends binary")
    near = materialize_bucketed(packed, "bucket", "lists", parts)
    told = lambda rows, what: rows.groupBy("bucket").cogroup(near.groupBy("bucket")).applyInArrow(what(buckets), "bucket long, kind long, n long, cells long, moved long, x binary, y binary, z binary")
    state, moved = None, 1
    while moved:
        new = told(near.select("bucket"), _begun) if state is None else state
        for _ in range(rounds):
            new = told(new.repartition(parts, "bucket"), _step)
        new, seen = materialize_watched(new, "core", moved=F.max("moved"))
        discard(state)
        state, moved = new, seen["moved"]
    discard(near)
    return state.where(F.col("kind") == STATE).mapInArrow(_cores(buckets), "id long, coreness long")


def _peel(graph: Graph, trace: list[dict] | None = None) -> DataFrame:
    """Vertices of at most k arcs go, round after round, before k grows.

    What is known of a vertex and the arcs that it loses meet in one exchange, and the least degree left is taken while
    the round is written.  ``trace`` gets ``k, left`` for each round: vertices that are left when it begins, about.
    """
    none, left = F.lit(None).cast("long"), F.col("coreness").isNull()
    watched = {"low": F.min(F.when(left, F.col("degree"))), "left": F.count_if(left)}
    state, seen = materialize_watched(graph.out_degrees().select("id", "degree", none.alias("coreness")), "core", **watched)
    k = 0
    while seen["low"] is not None:
        k = max(k, seen["low"])
        if trace is not None:
            trace.append({"k": k, "left": seen["left"]})
        going = left & (F.col("degree") <= k)
        gone = state.where(going).select(F.col("id").alias("dst"))
        lost = graph.by_dst().join(gone, "dst").select(F.col("src").alias("id"), none.alias("degree"), none.alias("coreness"), F.lit(1).alias("lost"))
        kept = state.select("id", "degree", F.when(going, F.lit(k)).otherwise(F.col("coreness")).alias("coreness"), F.lit(0).alias("lost"))
        met = kept.unionByName(lost).groupBy("id").agg(F.max("degree").alias("degree"), F.max("coreness").alias("coreness"), F.sum("lost").alias("lost"))
        step, seen = materialize_watched(met.select("id", F.when(left, F.col("degree") - F.col("lost")).otherwise(F.col("degree")).alias("degree"), "coreness"), "core", **watched)
        discard(state)
        state = step
    return state.select("id", "coreness")


def kcore(graph: Graph, strategy: str = "hindex", allow_directed: bool = False, **how) -> DataFrame:
    """``id, coreness`` for every vertex of an undirected graph (``allow_directed``: peel by out-degree); ``peel`` takes a ``trace``, ``hindex`` how many ``rounds`` go into a table."""
    if graph.directed and not allow_directed:
        raise ValueError("coreness is defined for undirected graphs")
    return {"hindex": _hindex, "peel": _peel}[strategy](graph, **how)


def kcore_stats(cores: DataFrame) -> DataFrame:
    return cores.agg(F.max("coreness").alias("max_coreness"), F.sum("coreness").alias("sum_coreness"))
