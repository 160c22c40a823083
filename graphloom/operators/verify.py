"""Checks of results by properties that only a right result has; each gives True or False."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.betweenness import betweenness
from graphloom.operators.components import connected_components
from graphloom.operators.kcore import kcore
from graphloom.operators.recommend import recommend_many
from graphloom.operators.triangles import triangle_count
from graphloom.plans.materialize import materialize


def _none(rows: DataFrame) -> bool:
    return not rows.head(1)


def verify_bfs(graph: Graph, source: int, tree: DataFrame) -> bool:
    """The source is its own parent at depth 0, parents are one step up by an arc, and no arc skips a level or leaves the tree."""
    root = tree.where((F.col("id") == source) & (F.col("depth") == 0) & (F.col("parent") == source)).count() == 1
    far = tree.select(F.col("id").alias("dst"), F.col("depth").alias("to"), "parent")
    arcs = graph.by_src().join(tree.select(F.col("id").alias("src"), "depth"), "src").join(far, "dst", "left")
    skips = arcs.where("to is null or to > depth + 1")
    held = arcs.where("src = parent and to = depth + 1").select("dst").distinct().count()
    return root and _none(skips) and held == tree.count() - 1


def verify_sssp(graph: Graph, source: int, dist: DataFrame) -> bool:
    """No arc can be relaxed, and every vertex but the source is reached by one that is tight."""
    to = dist.select(F.col("id").alias("dst"), F.col("dist").alias("there"))
    arcs = graph.by_src().join(dist.select(F.col("id").alias("src"), "dist"), "src").join(to, "dst", "left")
    tight = arcs.where((F.col("there") == F.col("dist") + F.col("weight")) & (F.col("dst") != source)).select("dst").distinct().count()
    begun = dist.where((F.col("id") == source) & (F.col("dist") == 0)).count() == 1
    return begun and _none(arcs.where("there is null or there > dist + weight")) and tight == dist.count() - 1


def verify_ppsp(graph: Graph, source: int, dest: int, dist: int | None, met: DataFrame) -> bool:
    """Whether ``dist`` (null: not reached) is the distance of ``dest``, by what its search has met (``search``: id, dist).

    A way back from ``dest`` over arcs that are tight shows that it is not too small.  That it is not too large: every
    vertex nearer than ``dist`` has been extended, so what its arcs lead to is no farther than they say, or not nearer
    than ``dist`` itself.  Vertices beyond need not be final, nor need they have been extended.
    """
    far = met.select(F.col("id").alias("dst"), F.col("dist").alias("there"))
    near = met if dist is None else met.where(F.col("dist") < dist)
    arcs = graph.by_src().join(near.select(F.col("id").alias("src"), "dist"), "src").join(far, "dst", "left").withColumn("via", F.col("dist") + F.col("weight"))
    missed = arcs.where("there is null or there > via")
    claimed = met.where(F.col("id") == dest).head()
    start = met.where((F.col("id") == source) & (F.col("dist") == 0)).count() == 1
    if not start or (claimed["dist"] if claimed else None) != dist or not _none(missed if dist is None else missed.where(F.col("via") < dist)):
        return False
    if dist is None:
        return True
    # back from dest, a step at a time; steps of weight 0 may go in circles
    front = materialize(met.where(F.col("id") == dest).select("id", "dist"), "back")
    seen = front
    while not front.where(F.col("id") == source).head(1):
        ends = front.select(F.col("id").alias("dst"), F.col("dist").alias("there"))
        back = graph.by_dst().join(ends, "dst").join(met.select(F.col("id").alias("src"), "dist"), "src").where(F.col("dist") + F.col("weight") == F.col("there"))
        front = materialize(back.select(F.col("src").alias("id"), "dist").distinct().join(seen.select("id"), "id", "left_anti"), "back")
        if not front.head(1):
            return False
        seen = seen.unionByName(front)
    return True


def verify_recommendation(trust: Graph, ratings: Graph, source: int, best: DataFrame, k: int = 5, hops: int = 3, above: int = 3) -> bool:
    """``best`` (item, votes) are the items that an independent search for all sources together ranks first."""
    want = recommend_many(trust, ratings, trust.vertices().where(F.col("id") == source), k, hops, above).select("item", "votes")
    return _none(want.exceptAll(best.select("item", "votes"))) and _none(best.select("item", "votes").exceptAll(want))


def verify_pagerank(graph: Graph, scores: DataFrame, tolerance: float = 1e-4, damping: float = 0.85) -> bool:
    """One more round changes scores by less than ``tolerance`` in sum."""
    share = scores.join(graph.out_degrees().where("degree > 0"), "id").select("id", (F.col("score") / F.col("degree")).alias("share"))
    sums = share.join(graph.by_src(), F.col("id") == F.col("src")).groupBy("dst").agg(F.sum("share").alias("sum"))
    new = (1 - damping) / max(graph.nodes, 1) + damping * F.coalesce("sum", F.lit(0.0))
    return (scores.join(sums, scores["id"] == sums["dst"], "left").agg(F.sum(F.abs(new - F.col("score")))).head()[0] or 0.0) < tolerance


def verify_components(graph: Graph, labels: DataFrame) -> bool:
    """``labels`` (id, component) are those that plain propagation gives, and each vertex has one."""
    want = graph.vertices().join(connected_components(graph.edges, "propagate"), "id", "left").select("id", F.coalesce("component", "id").alias("_want"))
    return labels.count() == graph.nodes and _none(want.join(labels, "id", "left").where("component is null or component <> _want"))


def verify_betweenness(graph: Graph, sources: list[int], scores: DataFrame, tolerance: float = 1e-6) -> bool:
    """Scores are the sum of those from each source alone, normalized."""
    total = None
    for s in sources:
        one = betweenness(graph, graph.vertices().where(F.col("id") == s), normalized=False)
        total = one if total is None else total.unionByName(one)
    want = total.groupBy("id").agg(F.sum("score").alias("_want"))
    most = want.agg(F.max("_want")).head()[0] or 1.0
    return scores.count() == graph.nodes and _none(want.join(scores, "id", "left").where(F.col("score").isNull() | (F.abs(F.col("score") - F.col("_want") / most) > tolerance)))


def verify_triangles(graph: Graph, triangles: int) -> bool:
    """Common neighbours summed up over all arcs count every triangle six times."""
    e = graph.edges.select("src", "dst")
    wedge = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("c")), "dst").join(e.select("src", F.col("dst").alias("c")), ["src", "c"])
    return wedge.count() == 6 * triangles and triangle_count(graph, "intersect").head()[0] == triangles


def verify_kcore(graph: Graph, cores: DataFrame) -> bool:
    """Peeling gives the same coreness."""
    want = kcore(graph, "peel", allow_directed=graph.directed).withColumnRenamed("coreness", "_want")
    return cores.count() == graph.nodes and _none(want.join(cores, "id", "left").where("coreness is null or coreness <> _want"))
