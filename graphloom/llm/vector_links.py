"""Embedding near-dedup (op 8): a subspace pigeonhole join.

For unit vectors, cosine >= c means squared distance <= 2 - 2c.  After a rotation the
coordinates are split into blocks, and the squared distance is the sum over blocks,
so a linked pair has at least one block whose share is within that block's budget.
Budgets are in proportion to the blocks' variance and add up to the whole.  Each block is range-joined
on its own, and the union of the candidates is verified exactly, in double precision
on the given vectors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._rows import bound_batches
from graphloom.operators.components import connected_components
from graphloom.plans.materialize import materialize


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1.  They are brought to the same power of two first, so that no square is too large or too small."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def principal_rotation(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, variances) from second moments over all rows; the driver gets 16 square matrices at most."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, n = None, None, 0
        for batch in batches:
            x = _matrix(batch["embedding"])
            if not len(x):
                continue
            x = unit(x)
            total = x.T @ x if total is None else total + x.T @ x
            first = x.sum(0) if first is None else first + x.sum(0)
            n += len(x)
        if total is not None:
            cells = np.concatenate([[float(n)], first, total.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()], pa.binary())], names=["cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_buffer()) for b in batches for x in b["cells"]]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([sum(parts).tobytes()], pa.binary())], names=["cells"])

    # in two steps, so that neither a task nor the driver meets a matrix of every partition
    sums = vectors.select("embedding").mapInArrow(moments, "cells binary").repartition(16).mapInArrow(added, "cells binary").collect()
    if not sums:
        return np.empty((0, 0)), np.empty(0)
    cells = sum(np.frombuffer(bytes(r["cells"])) for r in sums)
    d = int((np.sqrt(4 * len(cells) - 3) - 1) / 2)
    n, mean = cells[0], cells[1 : d + 1] / cells[0]
    spread, axes = np.linalg.eigh(cells[d + 1 :].reshape(d, d) / n - np.outer(mean, mean))
    return axes[:, ::-1], np.maximum(spread[::-1], 1e-12)


def deal_blocks(variances: np.ndarray, blocks: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Axes dealt to blocks round about, the strongest of each block first, and each block's share of the variance."""
    blocks = max(1, min(blocks, len(variances)))
    parts = [np.arange(k, len(variances), blocks) for k in range(blocks)]
    shares = np.array([variances[p].sum() for p in parts])
    return parts, shares / shares.sum()


#: Cells along an axis are fewer, as coordinates of unit vectors lie within 1 and radii are not that small.
_GRID = 1 << 20


def later_cells(axes: int) -> list[tuple[int, ...]]:
    """A cell's own place and those of the cells beside it that come after it: of each two neighbours, one visits the other."""
    zero = (0,) * axes
    return [step for step in itertools.product((-1, 0, 1), repeat=axes) if step >= zero]


def paying_axes(spread: np.ndarray, radius: float, most: int = 3) -> int:
    """How many axes of a block to cut: the strongest, and further ones as long as cutting rules out more than it adds.

    A further axis multiplies a class's places by about 2.5.  Of pairs with normal coordinates of standard deviation s
    a share of about erf(1.5 radius / 2 s) lie in the same cell or in neighbouring ones, which has to be under 0.4.
    """
    n = 1
    while n < min(most, len(spread)) and math.erf(0.75 * radius / spread[n]) < 0.4:
        n += 1
    return n


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.empty((0, 0))


def _usable(embedding) -> F.Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0)


_CELL = "label string, block int, cell long, home boolean, tile int, id long, weight long, embedding array<{}>"


def link_vectors(
    vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", blocks: int = 4, axes: int | None = None, tile: int = 2048
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: direct links, and the smallest id reachable.

    Rows are compared only within equal, non-null labels.  Equal vectors of a label are one class with a weight, so
    exact copies are never paired.  The range join cuts the strongest axes of a block (as many as pay, or ``axes``) into
    a grid of cells as wide as the block's radius; a class is at home in its cell and visits those beside it that come later, so each
    pair within the radius meets in exactly one cell of that block, and it is counted only in the first block that
    is within budget.  A cell
    of more than ``tile`` classes is cut into tiles that meet pairwise, each in a task of its own.  Tasks put out
    counts and a spanning forest of their links, not the links, so output does not grow with the square of a group.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do rows
    with a null label (labels are compared as text); vectors of any finite size are compared by direction, vectors of another length than the most common one of their label set are compared among
    their own length only.  Rows that repeat an id are vectors of their own for ``n_links`` and share a component.
    A null id counts as the largest and is carried through.  Other columns are not read.
    """
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    # floats travel as such and are doubles where they are compared
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x.cast(kind)))
    rows = rows.withColumn("use", F.coalesce(F.col("label").isNotNull() & _usable(F.col("embedding")), F.lit(False)))
    # -0.0 and 0.0 are the same component
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))
    used = rows.where("use")
    # a class has an id of its own, for rows of several classes may share a vec_id or have none; it is fixed by being written
    classes = materialize(used.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("weight")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    counts = edges = None
    for (size,) in sorted(classes.select(F.size("embedding")).distinct().collect()):
        found = materialize(_join(classes.where(F.size("embedding") == size), cosine, blocks, axes, tile), "links")
        part_counts = found.where("other is null").select("label", "id", "n")
        part_edges = found.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst"))
        counts = part_counts if counts is None else counts.unionByName(part_counts)
        edges = part_edges if edges is None else edges.unionByName(part_edges)
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    total = counts.groupBy("id").agg(F.sum("n").alias("n"))
    named = classes.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), F.col("id").alias("class"), "weight")
    # merged, so that adaptive execution can split the partition of a vector with many copies
    members = rows.join(named.hint("merge"), rows["use"] & (rows["label"] == named["_label"]) & (rows["embedding"] == named["_embedding"]), "left")
    members = materialize(members.select("vec_id", "class", "weight"), "members")
    # classes that share a vec_id are one component
    owned = members.where("vec_id is not null and class is not null").select("vec_id", "class").distinct()
    first = owned.groupBy("vec_id").agg(F.min("class").alias("first"))
    edges = edges.unionByName(owned.join(first, "vec_id").where("class <> first").select(F.col("class").alias("src"), F.col("first").alias("dst")))
    parts = connected_components(edges)
    placed = classes.select(F.col("id").alias("_class")).join(parts, F.col("_class") == F.col("id"), "left").select("_class", F.coalesce("component", "_class").alias("part"))
    placed = materialize(placed, "placed")
    # the least vec_id of each component, null where all are
    least = members.join(placed, F.col("class") == F.col("_class")).groupBy("part").agg(F.min("vec_id").alias("least")).withColumnRenamed("part", "_part")
    homes = placed.join(least, F.col("part") == F.col("_part")).select("_class", "least")
    # rows without a class go with the other rows of their id
    others = first.join(homes, F.col("first") == F.col("_class")).select(F.col("vec_id").alias("_vec_id"), F.col("least").alias("theirs"))
    joined = (
        members.join(homes, F.col("class") == F.col("_class"), "left")
        .join(total.select(F.col("id").alias("_id"), "n"), F.col("class") == F.col("_id"), "left")
        .join(others, F.col("class").isNull() & (F.col("vec_id") == F.col("_vec_id")), "left")
    )
    n_links = F.when(F.col("class").isNotNull(), F.coalesce("n", F.lit(0)) + F.col("weight") - 1).otherwise(0)
    component = F.coalesce("least", "theirs", "vec_id")
    return joined.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _join(classes: DataFrame, cosine: float, blocks: int, axes: int | None, tile: int) -> DataFrame:
    """(label, id, n, other): rows with ``other`` null count links of a class; the others are forest edges."""
    rotation, variances = principal_rotation(classes)
    if not len(variances):
        return classes.select("label", "id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("other")).limit(0)
    parts, shares = deal_blocks(variances, blocks)
    budget = (2 - 2 * cosine) * shares + 1e-9
    radius = np.sqrt(budget)
    cut = [min(len(p), axes) if axes else paying_axes(np.sqrt(variances[p]), r) for p, r in zip(parts, radius, strict=True)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["embedding"])
            if not len(x):
                continue
            y = unit(x) @ rotation
            for k, own in enumerate(parts):
                cells = [np.floor(y[:, a] / radius[k]).astype(np.int64) for a in own[: cut[k]]]
                for step in later_cells(len(cells)):
                    n = len(x)
                    cell = np.zeros(n, np.int64)
                    for c, move in zip(cells, step, strict=True):
                        cell = cell * _GRID + c + move
                    yield pa.RecordBatch.from_arrays(
                        [batch["label"], pa.array(np.full(n, k, np.int32)), pa.array(cell), pa.array(np.full(n, not any(step))), pa.array((_spread(batch["id"])).astype(np.int32)), batch["id"], batch["weight"], batch["embedding"]],
                        names=["label", "block", "cell", "home", "tile", "id", "weight", "embedding"],
                    )

    placed = classes.select("label", "id", "weight", "embedding").mapInArrow(place, _CELL.format(classes.schema["embedding"].dataType.elementType.simpleString()))
    full = placed.groupBy("label", "block", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where("any")
    # tiles: the square root of the number of pairs of tiles grows with the cell
    tiles = full.select(F.col("label").alias("_l"), F.col("block").alias("_b"), F.col("cell").alias("_c"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    met = placed.join(tiles, (F.col("label") == F.col("_l")) & (F.col("block") == F.col("_b")) & (F.col("cell") == F.col("_c")))
    mine = F.pmod(F.col("tile"), F.col("tiles")).cast("int")
    met = met.withColumn("tile", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("label", "block", "cell", F.least("tile", "with").alias("t1"), F.greatest("tile", "with").alias("t2"), "tile", "home", "id", "weight", "embedding")

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k, t1, t2 = (key[i].as_py() for i in (1, 3, 4))
        x = _matrix(table["embedding"].combine_chunks())
        x = unit(x)
        y = x @ rotation
        home, own = np.asarray(table["home"]), np.asarray(table["tile"])
        ids, weight = np.asarray(table["id"]), np.asarray(table["weight"])
        n = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        forest: list[tuple[int, int]] = []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        left = np.flatnonzero(home)
        for at in range(0, len(left), 1024):
            a = left[at : at + 1024]
            near = _square(y[a][:, parts[k]], y[:, parts[k]]) <= budget[k] + 1e-9
            # home with home once, home with every visitor; tiles of one kind meet themselves, others only across
            near &= ~home[None, :] | (np.arange(len(ids))[None, :] > a[:, None])
            if t1 != t2:
                near &= own[a][:, None] != own[None, :]
            i, j = np.nonzero(near)
            i = a[i]
            for e in range(k, -1, -1):
                d = y[i][:, parts[e]] - y[j][:, parts[e]]
                within = (d * d).sum(1) <= budget[e]
                keep = within if e == k else ~within
                i, j = i[keep], j[keep]
            for s in range(0, len(i), 1 << 16):
                p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                hit = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[hit], q[hit]
                np.add.at(n, p, weight[q])
                np.add.at(n, q, weight[p])
                for u, v in zip(p.tolist(), q.tolist(), strict=True):
                    ru, rv = top(u), top(v)
                    if ru != rv:
                        root[max(ru, rv)] = min(ru, rv)
                        forest.append((int(ids[u]), int(ids[v])))
        some = np.flatnonzero(n)
        lab = key[0].as_py()
        m = len(some) + len(forest)
        return pa.table(
            {
                "label": pa.array([lab] * m, pa.string()),
                "id": pa.array(ids[some].tolist() + [f[0] for f in forest], pa.int64()),
                "n": pa.array(n[some].tolist() + [0] * len(forest), pa.int64()),
                "other": pa.array([None] * len(some) + [f[1] for f in forest], pa.int64()),
            }
        )

    return met.groupBy("label", "block", "cell", "t1", "t2").applyInArrow(meet, "label string, id long, n long, other long")


def _spread(ids: pa.Array) -> np.ndarray:
    return (np.asarray(ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % (1 << 30)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
