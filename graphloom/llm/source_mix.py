"""Mixing sources to target weights (op 9) by a low-discrepancy schedule over equal-token blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._rows import bound_batches
from graphloom.plans.materialize import materialize

#: 2**64 divided by the golden ratio, made odd: steps of the golden-ratio sequence in 64-bit fixed point.
_GOLDEN = 0x9E3779B97F4A7C15


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets that share ``total`` by weight; none above ``most`` times its size, the excess reshared by weight."""
    caps = [most * s for s in sizes]
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > caps[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = caps[i]
            left -= caps[i]
            open_.discard(i)
    return targets


def golden_sources(first: int, count: int, cumulative: np.ndarray) -> np.ndarray:
    """Source number of the slots first .. first + count - 1: golden-ratio points mapped through cumulative shares."""
    n = np.arange(first, first + count, dtype=np.uint64) * np.uint64(_GOLDEN)
    points = (n >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.minimum(np.searchsorted(cumulative, points, side="right"), len(cumulative) - 1)


def _schedule(spark, shares: list[float], slots: int, chunk: int = 1 << 16) -> DataFrame:
    """(slot, source_no, rank): ranks count a source's slots in order; counted by chunk, so no source is one task's."""
    cumulative = np.cumsum(np.array(shares) / max(sum(shares), 1e-300))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch["id"].to_pylist():
                n = min(chunk, slots - c * chunk)
                s = golden_sources(c * chunk, n, cumulative)
                order = np.argsort(s, kind="stable")
                sorted_ = s[order]
                starts = np.searchsorted(sorted_, np.arange(len(cumulative)))
                nth = np.empty(n, np.int64)
                nth[order] = np.arange(n) - starts[sorted_]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c)), pa.array(np.arange(n) + c * chunk), pa.array(s.astype(np.int64)), pa.array(nth)], names=["chunk", "slot", "source_no", "nth"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch["id"].to_pylist():
                s = golden_sources(c * chunk, min(chunk, slots - c * chunk), cumulative)
                k, n = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), c)), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], names=["chunk", "source_no", "n"])

    chunks = spark.range(-(-slots // chunk))
    # the counts of a chunk are one row a source: 65,536 times fewer rows than slots
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = chunks.mapInArrow(counts, "chunk long, source_no long, n long").select("chunk", "source_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return chunks.mapInArrow(points, "chunk long, slot long, source_no long, nth long").join(base.hint("merge"), ["chunk", "source_no"]).select("slot", "source_no", (F.col("before") + F.col("nth")).alias("rank"))


def _positions(docs: DataFrame, seed: int, per_bucket: int) -> DataFrame:
    """Adds ``begin``: where the document starts in its source's shuffled stream.

    The shuffle is by hash, cut into ranges of the hash that hold about ``per_bucket`` documents.  Sums of ranges
    are added up first, so that the running sum of a hot source is spread over its ranges.
    """
    n = docs.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 1
    ranges = max(1, -(-n // per_bucket))
    spread = docs.withColumn("mark", F.xxhash64("doc_id", "size", "twin", F.lit(seed)))
    spread = spread.withColumn("part", F.expr(f"cast(floor((mark / 18446744073709551616D + 0.5D) * {ranges}) as long)"))
    sums = spread.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source_no").alias("_s"), F.col("part").alias("_p"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "part").orderBy("mark", "doc_id", "twin").rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return spread.join(sums, F.col("source_no").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))).withColumn("begin", F.col("base") + F.col("inside"))


class Mix:
    """A mixture of ``docs``: ``sources``, ``sized`` documents and the ``pieces`` that its slots take."""

    def __init__(self, sources: DataFrame, sized: DataFrame, pieces: DataFrame):
        self.sources, self.sized, self.pieces = sources, sized, pieces


def mix_sources(
    docs: DataFrame,
    pattern: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    block_tokens: int = 256,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    per_bucket: int = 5000,
) -> Mix:
    """Plan a mixture in which sources have the shares of ``pattern`` (repeated over sources by code point, null last).

    The mixture has ``share`` times all words; a source's target stops at ``most`` times its size and the excess
    is reshared by weight.  Each source's documents are shuffled and laid end to end, ``most`` times over, and cut
    into blocks of ``block_tokens``.  Slot n belongs to the source that the n-th golden-ratio point meets in the
    cumulative targets; the r-th slot of a source takes its r-th block.  Slots beyond a source's target are
    skipped, missing ones (the schedule is off by a few) follow at the end, and its last block is cut short, so
    the words taken are the target rounded down.

    ``pieces``: ``slot, source_no, doc_id, doc_begin, doc_end, lap``.  The driver holds one row per source (name,
    words); documents stay distributed.  Sizes are words, runs of bytes that are not ASCII white space.  Null and
    empty texts have size 0 and are never taken, null ids are ids; rows that repeat an id are separate documents
    (``twin`` numbers exactly repeated rows together, which share what they take equally).  Long texts are counted
    whole.  Other columns are not read.  Empty tables give empty parts.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(t.split()) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], batch["twin"], pa.array(n, pa.int64())], names=["doc_id", "source", "twin", "size"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("twin"), F.col(text_col).cast("binary").alias("text"))
    table = base.mapInArrow(sized, "doc_id long, source string, twin long, size long")
    table = materialize(table, "mix")
    found = table.groupBy("source").agg(F.sum("size").alias("words")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["words"] for r in found]
    weights = [pattern[i % len(pattern)] for i in range(len(found))]
    targets = water_fill(sizes, weights, share * sum(sizes), most)
    sources = spark.createDataFrame([(r["source"], i, r["words"], float(t)) for i, (r, t) in enumerate(zip(found, targets, strict=True))], "source string, source_no long, source_size long, target double")
    known = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    numbered = table.join(F.broadcast(known) if len(found) <= 10_000 else known, table["source"].eqNullSafe(known["_source"])).drop("_source")

    quota = [int(t) for t in targets]
    need = [-(-q // block_tokens) for q in quota]
    slots = sum(need)
    schedule = _schedule(spark, targets, slots) if slots else spark.createDataFrame([], "slot long, source_no long, rank long")
    wanted = spark.createDataFrame([(i, n, q) for i, (n, q) in enumerate(zip(need, quota, strict=True))], "source_no long, need long, quota long")
    got = schedule.groupBy("source_no").agg(F.count(F.lit(1)).alias("got"))
    late = wanted.join(got, "source_no", "left").where("need > coalesce(got, 0)").select("source_no", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("need") - 1)).alias("rank"))
    late = late.select((F.lit(slots) + F.col("rank")).alias("slot"), "source_no", "rank")
    slots_of = schedule.unionByName(late).join(F.broadcast(wanted) if len(found) <= 10_000 else wanted, "source_no").where("rank < need")
    slots_of = slots_of.select("slot", "source_no", "rank", (F.col("rank") * block_tokens).alias("from_"), F.least((F.col("rank") + 1) * block_tokens, "quota").alias("to_"))

    placed = _positions(numbered.where("size > 0"), seed, per_bucket)
    laps = placed.select("doc_id", "twin", "source_no", "size", F.explode(F.sequence(F.lit(0), F.lit(int(np.ceil(most)) - 1))).alias("lap"), (F.col("begin") + F.col("lap") * F.col("source_size")).alias("at"))
    cut = laps.select("*", F.explode(F.sequence(F.expr(f"at div {block_tokens}"), F.expr(f"(at + size - 1) div {block_tokens}"))).alias("rank"))
    # the planner takes the schedule for as small as the range it comes from, and would broadcast it
    pieces = cut.join(slots_of.hint("merge"), ["source_no", "rank"]).select(
        "slot", "source_no", "doc_id", "twin", "size", "lap", (F.greatest("at", "from_") - F.col("at")).alias("doc_begin"), (F.least(F.col("at") + F.col("size"), "to_") - F.col("at")).alias("doc_end")
    )
    return Mix(sources, numbered, pieces.where("doc_end > doc_begin"))


def _per_row(mix: Mix, *more: Column) -> DataFrame:
    """``doc_id, twin, size, source_size, target, taken`` for each row of the input, and ``more`` aggregates of its pieces.

    Rows that repeat id and text share their words evenly between them, the smaller remainder last.
    """
    key = ["doc_id", "twin", "source_no", "size"]
    taken = mix.pieces.groupBy(*key).agg(F.sum(F.col("doc_end") - F.col("doc_begin")).alias("taken"), *more)
    extra = [c for c in taken.columns if c not in (*key, "taken")]
    taken = taken.select(*[F.col(k).alias(f"_{k}") for k in key], "taken", *extra)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    once = mix.sized.groupBy("doc_id", "twin", "source_no", "size", "source_size", "target").agg(F.count(F.lit(1)).alias("rows"))
    joined = once.join(taken, same, "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    each = joined.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)))
    return each.select("doc_id", "twin", "size", "source_size", "target", F.expr("taken div rows + if(i < taken % rows, 1, 0)").cast("long").alias("taken"), *extra)


def words_taken(mix: Mix) -> DataFrame:
    """Per row of the input: ``doc_id, size, source_size, target, taken``.

    Rows that repeat id and text share their words evenly between them, the smaller remainder last.
    """
    return _per_row(mix).drop("twin")


def texts_taken(mix: Mix, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``words_taken`` with the ``text`` itself and its ``pieces`` (slot, first, last + 1), ranges of words by slot.

    The mixture is the pieces of all texts in the order of their slots.  Rows that repeat id and text carry the
    pieces of all of them together.
    """
    pieces = F.array_sort(F.collect_list(F.struct("slot", F.col("doc_begin").alias("first"), F.col("doc_end").alias("last")))).alias("pieces")
    rows = _per_row(mix, pieces)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_twin"), F.col(text_col).alias("text")).dropDuplicates(["_id", "_twin"])
    none = F.array().cast("array<struct<slot:long,first:long,last:long>>")
    met = rows.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("twin") == F.col("_twin")))
    return met.select("doc_id", "text", "size", "source_size", "target", "taken", F.coalesce("pieces", none).alias("pieces"))
