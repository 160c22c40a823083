"""Recommendation of items through a circle of trust."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.materialize import discard, materialize

#: At most so many bits of vertices and sources does a task hold of one hop (256 MB); lists go to fewer blocks than with less.
MATRIX_BITS = 1 << 31


def trust_circle(trust: Graph, source: int, hops: int = 3) -> DataFrame:
    """``id`` of the vertices reached in 1 to ``hops`` steps; the source itself only if a way leads back to it."""
    arcs = trust.edges.select("src", F.col("dst").alias("id"))
    step = arcs.where(F.col("src") == source).select("id").distinct()
    circle = step
    for _ in range(hops - 1):
        step = step.select(F.col("id").alias("src")).join(arcs, "src").select("id").distinct().join(circle, "id", "left_anti")
        circle = circle.unionByName(step)
    return circle


def recommend(trust: Graph, ratings: Graph, source: int, k: int | None = 5, hops: int = 3, above: int = 3, pad: bool = False) -> DataFrame:
    """``item, votes``: items that members of the circle rate over ``above``, by votes, then by larger item.

    ``pad`` fills up to ``k`` with item 0.  One plan without supersteps, as the number of hops is fixed.
    """
    likes = ratings.edges.where(F.col("weight") > above).select(F.col("src").alias("id"), F.col("dst").alias("item"))
    votes = trust_circle(trust, source, hops).where(F.col("id") < ratings.nodes).join(likes, "id").groupBy("item").agg(F.count(F.lit(1)).alias("votes"))
    if k is None:
        return votes
    best = votes.orderBy(F.desc("votes"), F.desc("item")).limit(k)
    if pad:
        fill = trust.spark.range(k).select(F.lit(0).cast("long").alias("item"), F.lit(0).cast("long").alias("votes"))
        best = best.unionByName(fill).orderBy(F.desc("votes"), F.desc("item")).limit(k)
    return best


def trust_circles(trust: Graph, sources: DataFrame, hops: int = 3) -> DataFrame:
    """``source, id`` for every ``id`` of ``sources``: the circles of all of them, hop by hop together."""
    arcs = trust.by_src()
    step = materialize(sources.select(F.col("id").alias("source")).distinct().join(arcs, F.col("source") == F.col("src")).select("source", F.col("dst").alias("id")), "circle")
    circle = [step]
    for _ in range(hops - 1):
        met = circle[-1].join(arcs, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id")).distinct()
        for known in circle:
            met = met.join(known, ["source", "id"], "left_anti")
        circle.append(materialize(met, "circle"))
    out = circle[0]
    for more in circle[1:]:
        out = out.unionByName(more)
    return out


def circle_bits(trust: Graph, sources: DataFrame, hops: int = 3) -> DataFrame:
    """``source, range, bits``: the circles of all ``sources`` as bitmaps of 32,768 ids each.

    The circle of a vertex is its out-neighbours and theirs of one hop less, so that no row stands for a source and a member.
    """
    arcs, among = trust.by_src(), lambda rows, end, ids: rows.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    wanted = [materialize(sources.select(F.col("id").cast("long").alias("id")).distinct(), "wanted")]
    for _ in range(hops - 1):
        wanted.append(materialize(among(arcs, "src", wanted[-1]).select(F.col("dst").alias("id")).distinct(), "wanted"))
    found = None
    for ids in reversed(wanted):
        mine = among(arcs, "src", ids).withColumnRenamed("src", "source")
        bits = mine.groupBy("source", F.bitmap_bucket_number("dst").alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("dst")).alias("bits"))
        if found is not None:
            further = mine.join(found.withColumnRenamed("source", "dst"), "dst").select("source", "range", "bits")
            bits = bits.unionByName(further).groupBy("source", "range").agg(F.bitmap_or_agg("bits").alias("bits"))
        nearer, found = found, materialize(bits, "circle")
        discard(nearer)
    discard(*wanted)
    return found


class _Block:
    """The circles of a range of sources: a row of bits for each vertex, a column for each source, and the best items so far."""

    def __init__(self, nodes: int, first: int, width: int, k: int):
        self.first, self.k, self.near, self.further = first, k, np.zeros((nodes, width // 64), np.uint64), None
        self.votes, self.items = np.zeros((width, k), np.int64), np.zeros((width, k), np.int64)
        self.columns = np.arange(width)

    def start(self, ids: np.ndarray, owner: np.ndarray, sources: np.ndarray) -> None:
        np.bitwise_or.at(self.near, (ids[owner], sources >> 6), np.uint64(1) << (sources & 63).astype(np.uint64))

    def next_hop(self) -> None:
        if self.further is not None:
            self.near = self.further
        self.live, self.further = self.near.any(axis=1), self.near.copy()

    def hop(self, ids: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> None:
        """A vertex is in all circles of the hop before that one of its in-neighbours is in."""
        for rows, begins, e in self._pieces(owner, ends, 1 << 12):
            self.further[ids[rows]] |= np.bitwise_or.reduceat(self.near[e], begins, axis=0)

    def _pieces(self, owner: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, where each begins, and ends that are in any circle, at most ``most`` of them at once."""
        kept = self.live[ends]
        owner, ends = owner[kept], ends[kept]
        for at in range(0, len(ends), most):
            o = owner[at : at + most]
            begins = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            yield o[begins], begins, ends[at : at + most]

    def _bits(self, rows: np.ndarray) -> np.ndarray:
        return np.unpackbits(rows.view(np.uint8), axis=1, count=len(self.columns), bitorder="little")

    def begin_votes(self) -> None:
        self.next_hop()
        self.further, self.group = None, 16
        self._keep(self._bits(np.bitwise_or.reduce(self.near, axis=0)[None, :])[0].astype(bool))

    def _keep(self, still: np.ndarray) -> None:
        """Only the columns that are ``still`` open go on."""
        if not still.all():
            words = -(-int(still.sum()) // 64)
            out = np.zeros((len(self.near), words * 8), np.uint8)
            for at in range(0, len(out), 1 << 11):
                bits = np.packbits(self._bits(self.near[at : at + (1 << 11)])[:, still], axis=1, bitorder="little")
                out[at : at + (1 << 11), : bits.shape[1]] = bits
            self.near, self.columns = out.view(np.uint64), self.columns[still]
        self.live = self.near.any(axis=1)

    def vote(self, items: np.ndarray, owner: np.ndarray, fans: np.ndarray) -> None:
        """Votes of ``items``, which come by falling number of fans, that is by the most votes that they can have."""
        totals, at = np.bincount(owner, minlength=len(items)), 0
        while at < len(items) and len(self.columns):
            n = min(self.group, max(1, (1 << 21) // len(self.columns)))
            lo, hi = np.searchsorted(owner, [at, at + n])
            votes = np.zeros((n, len(self.columns)), np.int32)
            for rows, begins, f in self._pieces(owner[lo:hi] - at, fans[lo:hi], max(64, (1 << 23) // len(self.columns))):
                # bytes hold sums of less than 256 fans
                small = np.diff(begins, append=len(f)).max() < 256
                votes[rows] += np.add.reduceat(self._bits(self.near[f]), begins, axis=0, dtype=np.uint8 if small else np.int32)
            least = self.votes[self.columns, -1]
            item, column = np.nonzero(votes >= np.maximum(least, 1))
            self._merge(self.columns[column], votes[item, column].astype(np.int64), items[at + item])
            at, self.group = at + n, self.group * 2
            still = self.votes[self.columns, -1] <= totals[min(at, len(items)) - 1]
            if still.sum() * 4 <= len(still):
                self._keep(still)

    def _merge(self, column: np.ndarray, votes: np.ndarray, items: np.ndarray) -> None:
        better = (votes > self.votes[column, -1]) | (items > self.items[column, -1])
        touched = np.unique(column[better])
        column, votes, items = (np.concatenate([x[better], old]) for x, old in ((column, np.repeat(touched, self.k)), (votes, self.votes[touched].ravel()), (items, self.items[touched].ravel())))
        order = np.lexsort((-items, -votes, column))
        column, votes, items = column[order], votes[order], items[order]
        rank = np.arange(len(column)) - np.searchsorted(column, column)
        best = rank < self.k
        self.votes[column[best], rank[best]], self.items[column[best], rank[best]] = votes[best], items[best]

    def ranked(self) -> pa.RecordBatch:
        column, rank = np.nonzero(self.votes)
        return pa.RecordBatch.from_pydict({"source": self.first + column, "item": self.items[column, rank], "votes": self.votes[column, rank], "rank": (rank + 1).astype(np.int32)})


def _ranked(nodes: int, width: int, k: int, hops: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best items of blocks of sources, from lists (block, step, id, ends) in order of block and step: arcs of the sources,
    arcs of all vertices once for each further hop, then the items' fans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = None, (None, 0)
        for batch in batches:
            blocks, steps = batch["block"].to_numpy(), batch["step"].to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(steps) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != now[0]:
                    if block:
                        yield block.ranked()
                    block, now = _Block(nodes, int(blocks[a]) * width, width, k), (blocks[a], 1)
                for step in range(now[1] + 1, steps[a] + 1):
                    block.next_hop() if step <= hops else block.begin_votes()
                now = (blocks[a], steps[a])
                part = batch.slice(a, b - a)
                at = part["ends"].offsets.to_numpy()
                ends, owner = part["ends"].values.to_numpy()[at[0] : at[-1]], np.repeat(np.arange(b - a), np.diff(at))
                (block.start if steps[a] == 1 else block.hop if steps[a] <= hops else block.vote)(part["id"].to_numpy(), owner, ends)
        if block:
            yield block.ranked()

    return run


def recommend_many(trust: Graph, ratings: Graph, sources: DataFrame, k: int = 5, hops: int = 3, above: int = 3) -> DataFrame:
    """``source, item, votes, rank``: what ``recommend`` gives for each ``id`` of ``sources``; none for a source without items.

    Circles are neither written nor exchanged.  A task follows a block of sources as columns of bits, hop by hop, over the
    lists of in-neighbours that stream past it, then over the items' fans, items with most fans first, until no item left can
    have more votes than those ranked.  A block is as wide as its bits fit into a bounded matrix, or less, for all cores to have some.
    """
    slots = 2 * trust.spark.sparkContext.defaultParallelism
    width = max(64, min(MATRIX_BITS // max(trust.nodes, 1) // 64, -(-trust.nodes // (64 * slots))) * 64)
    listed = lambda rows, end: F.collect_list(F.col(end).cast("int")).alias(rows)
    own = trust.edges.join(sources.select(F.col("id").cast("long").alias("src")).distinct(), "src", "left_semi").select(F.expr(f"src div {width}").alias("block"), (F.col("src") % width).alias("at"), F.col("dst").alias("id"))
    blocks = materialize(own.select("block").distinct(), "blocks")
    likes = ratings.edges.where((F.col("weight") > above) & (F.col("src") < min(trust.nodes, ratings.nodes)))
    fans = likes.groupBy(F.col("dst").alias("id")).agg(listed("ends", "src"))
    steps = [own.groupBy("block", "id").agg(listed("ends", "at")).withColumn("step", F.lit(1))]
    if hops > 1:
        turns = blocks.crossJoin(trust.spark.range(2, hops + 1).select(F.col("id").cast("int").alias("step")))
        steps.append(trust.edges.groupBy(F.col("dst").alias("id")).agg(listed("ends", "src")).crossJoin(F.broadcast(turns)))
    steps.append(fans.crossJoin(F.broadcast(blocks)).withColumn("step", F.lit(hops + 1)))
    columns = ["block", "step", "id", "ends"]
    streamed = reduce(DataFrame.unionByName, [s.select(*columns) for s in steps]).repartition(max(1, blocks.count()), "block")
    # of lists of neighbours the order does not matter
    ordered = streamed.sortWithinPartitions("block", "step", F.desc(F.size("ends"))).select(*columns)
    ranked = materialize(ordered.mapInArrow(_ranked(trust.nodes, width, k, hops), "source long, item long, votes long, rank int"), "ranked")
    discard(blocks)
    return ranked
