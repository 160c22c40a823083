"""Connected components of a graph whose arcs arrive in batches.

The state is a folder.  ``members/batch=k`` holds the vertices that batch k was the first to name, with the component they
had after it; ``merges/batch=k`` holds, for every component that has been swallowed since the members were last rewritten, the one it belongs
to after batch k.  A batch reads what its own vertices need, contracts the arcs between their components and
writes two small tables; members are rewritten every ``compact`` batches.  A batch counts once its ``merges`` are
complete, so one that is lost and comes again is done again from the state before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.plans.materialize import discard, materialize

_MEMBERS, _MERGES = "id long, component long", "old long, component long"


class StreamingComponents:
    """Labels (the least vertex id of each component) under arcs that are only ever added."""

    def __init__(self, spark: SparkSession, folder: str, compact: int = 16):
        self.spark, self.folder, self.compact = spark, folder.rstrip("/"), compact

    # -- state ------------------------------------------------------------------

    def _batches(self, kind: str) -> list[int]:
        """Batches whose table of this kind is complete."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(f"{self.folder}/{kind}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName().partition("=")[2]) for p in names if fs.exists(jvm.Path(p, "_SUCCESS")))

    def _read(self, kind: str, batches: list[int], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{kind}/batch={k}" for k in batches])

    def _state(self, before: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(members, merges) as they were before a batch."""
        done = [k for k in self._batches("merges") if before is None or k < before]
        if not done:
            return self._read("members", [], _MEMBERS), self._read("merges", [], _MERGES)
        first = max([k for k in self._batches("rewritten") if k <= done[-1]], default=None)
        members = self._read("members", [k for k in done if first is None or k > first], _MEMBERS)
        if first is not None:
            members = members.unionByName(self._read("rewritten", [first], _MEMBERS))
        return members, self._read("merges", done[-1:], _MERGES)

    def labels(self) -> DataFrame:
        """``id, component`` of all vertices named so far."""
        members, merges = self._state()
        return members.join(merges.withColumnRenamed("component", "_now"), F.col("component") == F.col("old"), "left").select("id", F.coalesce("_now", "component").alias("component"))

    # -- batches ----------------------------------------------------------------

    def add(self, arcs: DataFrame, batch: int) -> None:
        """Take in a batch of arcs (src, dst); loops name their vertex, null ends nothing.  Made for ``foreachBatch``."""
        arcs = materialize(arcs.select("src", "dst").where("src is not null and dst is not null"), "arcs")
        members, merges = self._state(before=batch)
        named = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        between = arcs
        if not any(k < batch for k in self._batches("merges")):
            ends = materialize(named.select("id", F.col("id").alias("component"), F.lit(True).alias("new")), "ends")
        else:
            known = named.join(members, "id", "left").join(merges.withColumnRenamed("component", "_now"), F.col("component") == F.col("old"), "left")
            ends = materialize(known.select("id", F.coalesce("_now", "component", "id").alias("component"), F.col("component").isNull().alias("new")), "ends")
            a, b = (ends.select(F.col("id").alias(end), F.col("component").alias(to)) for end, to in (("src", "a"), ("dst", "b")))
            between = arcs.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        joined = connected_components(between)
        # new vertices are written with the component they come to; only older ones are merged
        ends.where("new").select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component")).write.mode("overwrite").parquet(f"{self.folder}/members/batch={batch}")
        fell = ends.where("not new").select(F.col("component").alias("old")).distinct().join(joined.withColumnRenamed("id", "old"), "old").where("old <> component")
        # what had been swallowed by a component that falls now belongs to the same one as it does
        carried = merges.join(fell.select(F.col("old").alias("_old"), F.col("component").alias("_new")), F.col("component") == F.col("_old"), "left").select("old", F.coalesce("_new", "component").alias("component"))
        every = carried.unionByName(fell)
        if self.compact and batch % self.compact == self.compact - 1:
            whole = members.join(every.withColumnRenamed("component", "_now"), F.col("component") == F.col("old"), "left").select("id", F.coalesce("_now", "component").alias("component"))
            whole.unionByName(self._read("members", [batch], _MEMBERS)).write.mode("overwrite").parquet(f"{self.folder}/rewritten/batch={batch}")
            every = self._read("merges", [], _MERGES)
        every.write.mode("overwrite").parquet(f"{self.folder}/merges/batch={batch}")
        discard(arcs, ends, joined)


def stream_components(arcs: DataFrame, folder: str, checkpoint: str, compact: int = 16):
    """Start a query that keeps the components of a stream of arcs (src, dst) in ``folder``; it ends when the input does.

    Started again on the same folders it goes on where it was.
    """
    state = StreamingComponents(arcs.sparkSession, folder, compact)
    return arcs.writeStream.foreachBatch(state.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
