"""The graph model: an edge table in canonical form over the vertices 0 .. n - 1."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans.materialize import discard, materialize, materialize_bucketed


def squish(edges: DataFrame) -> DataFrame:
    """One row per arc (the least weight of parallel ones), without self-loops."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every arc and its mirror, which has the same weight."""
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def mirrored(edges: DataFrame) -> DataFrame:
    """``symmetrize`` in one pass, for plans that are dear to run twice."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ends).alias("_ends"), "weight").select("_ends.src", "_ends.dst", "weight")


def bucket_number(spark: SparkSession, rows: int) -> int:
    """How many partitions ``rows`` rows are dealt to: what the session says, more beyond two million rows in each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (1 << 21)))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


@dataclass
class Graph:
    """``edges`` (src, dst, weight: long) are canonical; ids up to the largest one seen are vertices, linked or not.

    An undirected graph stores both arcs of each edge.  ``edges`` may be a lazy plan; supersteps read ``by_src()``,
    which is written once.
    """

    edges: DataFrame
    nodes: int
    directed: bool = True
    buckets: int | None = field(default=None, kw_only=True)
    _by_src: DataFrame | None = field(default=None, repr=False)
    _by_dst: DataFrame | None = field(default=None, repr=False)
    _degree_table: DataFrame | None = field(default=None, repr=False)
    _arcs: int | None = field(default=None, repr=False)

    # -- construction ---------------------------------------------------------

    @classmethod
    def from_tables(cls, df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, mirror: bool = False, nodes: int | None = None, canonical: bool = False, rows: int = 0) -> Graph:
        """A graph from any table with two id columns; rows with a null end are no edges, a missing weight is 1.

        Without ``nodes`` the edges are written at once, and the largest id is taken on the way, so ``df`` is read once.
        ``rows``: about how many rows ``df`` has; large tables get more buckets.
        """
        w = F.coalesce(F.col(weight).cast("long"), F.lit(1)) if weight else F.lit(1)
        raw = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), w.cast("long").alias("weight")).where("src is not null and dst is not null")
        n = bucket_number(raw.sparkSession, rows * (2 if mirror else 1))
        if nodes is not None:
            edges = raw if canonical else squish(mirrored(raw) if mirror else raw)
            return cls(edges, nodes, not mirror, buckets=n)
        # loops and doubles count here: an id that has only a loop is a vertex
        seen, most = Observation(), F.max(F.greatest("src", "dst")).alias("most")
        watched = raw.observe(seen, most)
        # dealt by source first: arcs meet their doubles there, and are written where they are
        dealt = (mirrored(watched) if mirror and not canonical else watched).repartition(n, "src")
        table = materialize_bucketed(dealt if canonical else squish(dealt), "src", "edges", n, exchange=False)
        found = seen.get if "most" in seen.get else raw.agg(most).head().asDict()
        return cls(table, 0 if found["most"] is None else found["most"] + 1, not mirror, table, buckets=n)

    @classmethod
    def read(cls, spark: SparkSession, path: str, format: str | None = None, mirror: bool = False, **options) -> Graph:
        """A graph from a file; the format is the suffix unless given.  See ``graphloom.sources.readers``."""
        from graphloom.sources.readers import read_graph

        return read_graph(spark, path, format, mirror, **options)

    def write(self, path: str, format: str | None = None) -> None:
        from graphloom.sources.writers import write_graph

        write_graph(self, path, format)

    # -- views -----------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def vertices(self) -> DataFrame:
        return self.spark.range(self.nodes)

    def by_src(self) -> DataFrame:
        """The edges bucketed by ``src``: supersteps join their frontier with them and shuffle only the frontier."""
        if self._by_src is None:
            self._by_src = materialize_bucketed(self.edges, "src", "edges", self.buckets)
        return self._by_src

    def by_dst(self) -> DataFrame:
        """The edges bucketed by ``dst``, for supersteps that pull; in undirected graphs ``by_src`` with its ends swapped."""
        if not self.directed:
            return self.by_src().select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        if self._by_dst is None:
            self._by_dst = materialize_bucketed(self.edges, "dst", "edges", self.buckets)
        return self._by_dst

    def degree_table(self) -> DataFrame:
        """``id, degree`` of the vertices with out-arcs, written once, for plans that are chosen by the arcs of a frontier."""
        if self._degree_table is None:
            self._degree_table = materialize(self.by_src().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "degrees")
        return self._degree_table

    def arcs(self) -> int:
        """Stored arcs, counted once; an undirected edge has two."""
        if self._arcs is None:
            self._arcs = self.by_src().count()
        return self._arcs

    def cache(self) -> Graph:
        """The graph with its edges written, so that no later operator derives them again."""
        if self._by_src is not None and self.edges is self._by_src:
            return self
        return Graph(self.by_src(), self.nodes, self.directed, self._by_src, self._by_dst, buckets=self.buckets)

    def release(self) -> None:
        """Delete the tables written for this graph.  Results that still read them have to be written before."""
        discard(self._by_src, self._by_dst, self._degree_table)
        self._by_src = self._by_dst = self._degree_table = None

    def create_views(self, vertices: str = "vertices", edges: str = "edges") -> None:
        """Temporary views of the graph for ``spark.sql``."""
        self.vertices().createOrReplaceTempView(vertices)
        self.edges.createOrReplaceTempView(edges)

    def reverse(self) -> Graph:
        return Graph(transpose(self.edges), self.nodes, self.directed, buckets=self.buckets)

    def undirected(self) -> Graph:
        return self if not self.directed else Graph(squish(symmetrize(self.edges)), self.nodes, False)

    # -- degrees and statistics ------------------------------------------------

    def _degrees(self, end: str) -> DataFrame:
        counted = self.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        return self.vertices().join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))

    def out_degrees(self) -> DataFrame:
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def neighbors(self, vertex: int, skip: int = 0) -> DataFrame:
        """Out-neighbours in order of id, without the first ``skip``."""
        out = self.edges.where(F.col("src") == vertex).select(F.col("dst").alias("id"), "weight")
        return out if not skip else out.orderBy("id").offset(skip)

    def stats(self) -> DataFrame:
        """One row: ``nodes, edges`` (an undirected edge counts once), ``directed, degree`` (integer division)."""
        per_edge = 1 if self.directed else 2
        counted = self.edges.agg((F.count(F.lit(1)) / per_edge).cast("long").alias("edges"))
        return counted.select(F.lit(self.nodes).cast("long").alias("nodes"), "edges", F.lit(self.directed).alias("directed"), F.expr(f"edges div {max(self.nodes, 1)}").alias("degree"))

    def vertex_offsets(self) -> DataFrame:
        """``id, offset``: where a vertex's arcs begin when all are laid out by source.

        Offsets are summed up in ranges of ids first; only one row per range is ever in one task.
        """
        return running_sum(self.out_degrees().withColumnRenamed("degree", "value"), 1 << 16).select("id", F.col("before").alias("offset"))

    def adjacency_lists(self) -> DataFrame:
        return self.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))

    def relabel_by_degree(self) -> Graph:
        """Ids by falling degree, of equal degrees the larger old id first.  For undirected graphs."""
        if self.directed:
            raise ValueError("relabelling is defined for undirected graphs")
        ranks = self.degree_ranks()
        a = ranks.select(F.col("id").alias("src"), F.col("rank").alias("a"))
        b = ranks.select(F.col("id").alias("dst"), F.col("rank").alias("b"))
        moved = self.edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
        return Graph(moved, self.nodes, False)

    def degree_ranks(self, width: int = 1 << 16) -> DataFrame:
        """``id, degree, rank``.  Ranks start from counts per degree and, in it, per range of ``width`` ids, so that no
        window holds more than such a range, however many vertices share a degree."""
        deg = self.out_degrees().withColumn("part", F.expr(f"id div {width}"))
        counts = deg.groupBy("degree", "part").agg(F.count(F.lit(1)).alias("n"))
        above = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)
        base = counts.groupBy("degree").agg(F.sum("n").alias("n")).select("degree", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("base"))
        higher = Window.partitionBy("degree").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
        first = counts.select("degree", "part", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("first")).join(base, "degree")
        within = Window.partitionBy("degree", "part").orderBy(F.desc("id"))
        return deg.withColumn("nth", F.row_number().over(within) - 1).join(first, ["degree", "part"]).select("id", "degree", (F.col("base") + F.col("first") + F.col("nth")).alias("rank"))

    def segments(self, width: int, end: str = "dst") -> DataFrame:
        """The edges with ``segment``: the number of the range of ``width`` ids that their ``end`` lies in."""
        return self.edges.withColumn("segment", F.expr(f"{end} div {int(width)}"))

    def pick_sources(self, k: int = 1, seed: int = 1) -> DataFrame:
        """``k`` vertices with out-arcs, the same for the same seed."""
        return self.edges.select(F.col("src").alias("id")).distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k)

    def largest_ids(self) -> DataFrame:
        return self.edges.agg(F.max("src").alias("max_src"), F.max("dst").alias("max_dst"))


def running_sum(values: DataFrame, width: int, inclusive: bool = False, backward: bool = False) -> DataFrame:
    """``id, value, before``: sums of the values of smaller ids (``backward``: larger ones), in ranges of ``width`` ids."""
    order = F.desc if backward else F.asc
    part = F.expr(f"id div {width}")
    sums = values.groupBy(part.alias("part")).agg(F.sum("value").alias("total"))
    earlier = Window.orderBy(order("part")).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(order("id")).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    placed = values.withColumn("part", part).withColumn("inside", F.coalesce(F.sum("value").over(within), F.lit(0)))
    return placed.join(base, "part").select("id", "value", (F.col("base") + F.col("inside")).alias("before"))
