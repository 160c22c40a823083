"""Synthetic graphs, made block by block on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph

#: Seed of the first block, edges a block (each block is seeded anew), and the R-MAT quadrants.
SEED, BLOCK = 27491095, 1 << 18
QUADRANT_A, QUADRANT_B, QUADRANT_C = np.float32(0.57), np.float32(0.19), np.float32(0.19)


def _stream(block: int) -> np.random.MT19937:
    bits = np.random.MT19937()
    bits._legacy_seeding(SEED + block)
    return bits


def kronecker_block(block: int, scale: int, edges: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a block's edges: at each depth a random point picks the quadrant, that is a bit of each end."""
    raw = _stream(block).random_raw(edges * scale).astype(np.uint32)
    point = (raw.astype(np.float32) / np.float32(2**32)).reshape(edges, scale)
    half = QUADRANT_A + QUADRANT_B
    low = point >= half
    right = np.where(low, point > half + QUADRANT_C, point > QUADRANT_A)
    place = 1 << np.arange(scale - 1, -1, -1, dtype=np.int64)
    return low @ place, right @ place


def uniform_block(block: int, scale: int, edges: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a block's edges, drawn evenly by division with rejection of the surplus."""
    bits, step, n = _stream(block), (2**32 - 1) // (1 << scale), 1 << scale
    drawn = np.empty(0, np.int64)
    while len(drawn) < 2 * edges:
        more = bits.random_raw(2 * edges - len(drawn) + 64).astype(np.int64) // step
        drawn = np.concatenate([drawn, more[more < n]])
    return drawn[: 2 * edges : 2], drawn[1 : 2 * edges : 2]


def _generated(spark: SparkSession, scale: int, degree: int, make) -> DataFrame:
    total = degree << scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["id"].to_pylist():
                src, dst = make(block, scale, min(BLOCK, total - block * BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int64)), pa.array(dst.astype(np.int64))], names=["src", "dst"])

    blocks = -(-total // BLOCK)
    return spark.range(0, blocks, 1, blocks).mapInArrow(run, "src long, dst long")


def permute_ids(edges: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Edges with ids in a random order that the seed fixes.

    Ids are ordered by hash in ranges of it, so no task sorts all of them.
    """
    from pyspark.sql import Window

    ids = edges.sparkSession.range(n).withColumn("mark", F.xxhash64("id", F.lit(seed)))
    parts = max(1, n >> 16)
    ids = ids.withColumn("part", F.expr(f"cast(floor((mark / 18446744073709551616D + 0.5D) * {parts}) as long)"))
    sizes = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    new = ids.join(base, "part").select("id", (F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("mark", "id")) - 1).alias("new"))
    a, b = new.select(F.col("id").alias("src"), F.col("new").alias("a")), new.select(F.col("id").alias("dst"), F.col("new").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def kronecker(spark: SparkSession, scale: int, degree: int = 16, permute: bool = True) -> Graph:
    """An R-MAT graph of ``degree << scale`` drawn edges, undirected."""
    edges = _generated(spark, scale, degree, kronecker_block)
    return Graph.from_tables(permute_ids(edges, 1 << scale) if permute else edges, mirror=True)


def uniform(spark: SparkSession, scale: int, degree: int = 16) -> Graph:
    """A graph of ``degree << scale`` evenly drawn edges, undirected."""
    return Graph.from_tables(_generated(spark, scale, degree, uniform_block), mirror=True)


def random_weights(graph: Graph, most: int = 255, seed: int = SEED) -> Graph:
    """Weights 1 .. ``most`` by hash; both arcs of an undirected edge have the same."""
    ends = ("src", "dst") if graph.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    weight = F.pmod(F.xxhash64(*ends, F.lit(seed)), F.lit(most)) + 1
    return Graph(graph.edges.select("src", "dst", weight.cast("long").alias("weight")), graph.nodes, graph.directed)
