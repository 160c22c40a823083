"""Triangle counting on undirected graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.materialize import materialize_bucketed


def worth_relabelling(graph: Graph) -> bool:
    """Whether degrees are so uneven (average at least 10, mean over 1.3 times the median) that order by degree pays."""
    row = graph.out_degrees().agg(F.avg("degree"), F.percentile("degree", 0.5)).head()
    return (row[0] or 0) >= 10 and row[0] / 1.3 > row[1]


def _oriented(graph: Graph, order: str) -> DataFrame:
    """(a, b, rank): each edge once, from its lower end to its higher one, whose place in the order is (rank, b)."""
    if order == "auto":
        order = "degree" if worth_relabelling(graph) else "id"
    half = graph.edges.where("src < dst")
    if order == "id":
        return half.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).cast("long").alias("rank"))
    deg = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    x, y = deg.select(F.col("src"), F.col("n").alias("n1")), deg.select(F.col("src").alias("dst"), F.col("n").alias("n2"))
    # from fewer neighbours to more: no vertex then has more than sqrt(2 m) arcs out
    up = F.col("n1") <= F.col("n2")
    pick = lambda yes, no: F.when(up, F.col(yes)).otherwise(F.col(no))
    return half.join(x, "src").join(y, "dst").select(pick("src", "dst").alias("a"), pick("dst", "src").alias("b"), F.greatest("n1", "n2").alias("rank"))


def _range_width(e: DataFrame, nodes: int, most: int) -> int:
    """The widest range of ids (by powers of four) of which no vertex has more than ``most`` out-neighbours."""
    width = max(nodes, most)
    while width > most:
        longest = e.groupBy("a", F.expr(f"b div {width}")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0]
        if (longest or 0) <= most:
            break
        width = max(most, width // 4)
    return width


def _closed(e: DataFrame, width: int | None, buckets: int | None) -> DataFrame:
    """``n``: for arcs (a, b), how many of the out-neighbours of ``a`` behind ``b`` are out-neighbours of ``b`` too.

    An arc takes what is behind it in the list of ``a`` to ``b``: one row for an arc, not one for a pair of arcs.  Lists are
    written where ``b`` looks for its own; with ``width`` they are cut into ranges of that many ids.
    """
    n = buckets or int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.expr(f"b div {width}") if width else F.lit(0)
    listed = F.sort_array(F.collect_list(F.struct("rank", "b"))).alias("out")
    lists = materialize_bucketed(e.repartition(n, "a").groupBy("a", part.alias("part")).agg(listed), "a", "lists", n, exchange=False)
    if width:
        behind = "transform(filter(out, x -> x.rank > rank or (x.rank = rank and x.b > b)), x -> x.b)"
        arcs = e.join(lists, "a").select("b", "part", F.expr(behind).alias("p"))
    else:
        arcs = lists.select(F.col("out.b").alias("out"), "part", F.posexplode("out.b").alias("at", "b")).select("b", "part", F.expr("slice(out, at + 2, size(out))").alias("p"))
    q = lists.select(F.col("a").alias("b"), "part", F.col("out.b").alias("q"))
    return arcs.where(F.size("p") > 0).repartition(n, "b").join(q.hint("merge"), ["b", "part"]).select(F.size(F.array_intersect("p", "q")).cast("long").alias("n"))


def triangle_count(graph: Graph, strategy: str = "wedge", order: str = "degree", width: int = 4096) -> DataFrame:
    """One row, ``triangles``.

    ``wedge`` takes from each vertex, along an arc, the ends of the arcs behind it, to be closed at the arc's end;
    ``intersect`` meets the two ends' lists of out-neighbours edge by edge, ``segments`` does as ``wedge`` for a range of
    ids at a time, the widest of which no list has more than ``width``.  ``order`` orients by ``degree``, ``id`` or, by the
    degrees' spread, ``auto``.
    """
    if strategy not in ("wedge", "intersect", "segments"):
        raise ValueError(f"no strategy {strategy!r}")
    if graph.directed:
        raise ValueError("triangles are counted in undirected graphs")
    e = _oriented(graph, order)
    if strategy == "intersect":
        lists = e.groupBy("a").agg(F.collect_list("b").alias("out"))
        p, q = lists.select("a", F.col("out").alias("p")), lists.select(F.col("a").alias("b"), F.col("out").alias("q"))
        met = e.join(p, "a").join(q, "b").select(F.size(F.array_intersect("p", "q")).cast("long").alias("n"))
    else:
        cut = None
        if strategy == "segments":
            e = materialize_bucketed(e, "a", "oriented", graph.buckets)
            cut = _range_width(e, graph.nodes, width)
            cut = None if cut >= graph.nodes else cut
        met = _closed(e, cut, graph.buckets)
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triangles"))
