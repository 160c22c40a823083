"""Weakly connected components over an edge table.

Three strategies with the same labels (the smallest vertex id of each component):

* ``contract`` (default): every vertex hooks to its smallest smaller neighbour,
  the forest is flattened by pointer jumping, edges are rewritten between roots
  and deduplicated, and the shrunken edge table goes round again.  At least every
  vertex that has a smaller neighbour disappears in a round, so the edge table
  shrinks geometrically and the number of rounds is logarithmic.
* ``sampled``: two neighbours of each vertex are linked first; the component that most of a
  sample of vertices then lie in is as good as done, and neither arcs that leave it nor those linked are read again.
* ``propagate``: plain minimum-label propagation, kept as an independent check.

Many rows may look up one vertex: the root of a giant component, or a hub.  Such keys are found by counting before a
join; there are few of them by construction, so what they stand for is broadcast and the rows stay where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import bucket_number, mirrored
from graphloom.plans.materialize import discard, materialize, materialize_bucketed, materialize_watched, passed_on

#: Rows below which one task may hold all of a join key.
SMALL = 1 << 19


def _hot(rows: DataFrame, n: int, key: str) -> DataFrame | None:
    """The values of ``key`` (``_hot``) that more than a quarter of a task's share of the ``n`` rows has, None without any.

    Of many rows, those of some hash stand for the rest: about 256 for such a share.  A value that has half of them is taken,
    so there are at most eight for each task.  Which values are taken decides how rows travel, not what comes out.
    """
    share = n // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one_in = max(1, share // 256)
    drawn = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(one_in)) == 0) if one_in > 1 else rows
    least = share if one_in == 1 else share // (2 * one_in)
    hot, seen = materialize_watched(drawn.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select("_hot"), "hot", n=F.count(F.lit(1)))
    if seen["n"]:
        return hot
    discard(hot)
    return None


def look_up(rows: DataFrame, n: int, key: str, table: DataFrame, value: str, small: int = SMALL, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` (``n`` of them) with ``value`` of the row of ``table`` (``_key`` and ``value``) that ``key`` names, null where there is none.

    A key of more than a quarter of a task's share of the rows is hot, and looked up apart.  Where ``rows`` are dear to run
    twice, keys are counted in ``counted``, which has ``n`` rows and all of theirs.
    """
    met = lambda part: part.join(table, part[key] == table["_key"], "left").drop("_key")
    if n <= small:
        return met(rows)
    hot = _hot(rows if counted is None else counted, n, key)
    if hot is None:
        return met(rows)
    known = hot.join(table, hot["_hot"] == table["_key"], "left").select("_hot", value)
    few = rows.join(F.broadcast(known), rows[key] == known["_hot"]).drop("_hot")
    return few.unionByName(met(rows.join(F.broadcast(hot), rows[key] == hot["_hot"], "left_anti")))


def _flatten(parent: DataFrame, n: int) -> DataFrame:
    """Pointer jumping: ``(id, parent)`` forest of ``n`` rows to ``(id, root)``.

    A row whose parent has none, or has come to its root, is there too: it stays where it was written, and only the
    others jump on.
    """
    steps, active, left = [], parent, n
    while True:
        ups = [active.select(F.col("id").alias("_key"), F.struct(F.col("parent").alias("top"), F.lit(False).alias("there")).alias("_up"))]
        ups += [s.where("not moved").select(F.col("id").alias("_key"), F.struct(F.col("parent").alias("top"), F.lit(True).alias("there")).alias("_up")) for s in steps]
        up = reduce(DataFrame.unionByName, ups)
        if left <= SMALL < n:
            # few rows jump: the others need not travel to be looked up by them
            up = up.join(F.broadcast(active.select(F.col("parent").alias("_key")).distinct()), "_key", "left_semi")
        step = look_up(active, left, "parent", up, "_up").select("id", F.coalesce("_up.top", "parent").alias("parent"), F.coalesce(~F.col("_up.there"), F.lit(False)).alias("moved"))
        step, seen = materialize_watched(step, "flatten", moved=F.count_if("moved"))
        if not steps:
            discard(parent)
        steps.append(step)
        if not seen["moved"]:
            return passed_on(reduce(DataFrame.unionByName, [s.where("not moved").select("id", F.col("parent").alias("root")) for s in steps]), *steps)
        active, left = step.where("moved").select("id", "parent"), seen["moved"]


def _rooted(e: DataFrame, n: int, roots: DataFrame) -> DataFrame:
    """Edges (a, b) between the roots of their ends, without those inside a tree."""
    key = roots.select(F.col("id").alias("_key"), F.col("root"))
    a = look_up(e, n, "a", key, "root").select(F.coalesce("root", "a").alias("ra"), "b")
    # most edges of a hub lead to what it hooks to: they are gone before the other end is looked up
    b = look_up(a.where("ra <> b"), n, "b", key, "root", counted=e).select("ra", F.coalesce("root", "b").alias("rb"))
    return b.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).where("a > b").distinct()


def _contract(edges: DataFrame) -> DataFrame:
    rows = F.count(F.lit(1))
    e, seen = materialize_watched(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a > b").distinct(), "edges", n=rows)
    forests = []
    while seen["n"]:
        hooks, hooked = materialize_watched(e.groupBy("a").agg(F.min("b").alias("parent")).withColumnRenamed("a", "id"), "hook", n=rows)
        roots = _flatten(hooks, hooked["n"])
        forests.append((roots, hooked["n"]))
        e2, after = materialize_watched(_rooted(e, seen["n"], roots), "edges", n=rows)
        discard(e)
        e, seen = e2, after
    labels = passed_on(e.select(F.col("a").alias("id"), F.col("b").alias("component")), e)
    # from the last round, which is small, to the first: a vertex is named in the round that hooks it, the least of a component in that which completes it
    for roots, n in reversed(forests):
        following = labels.select(F.col("id").alias("_key"), F.col("component").alias("_next"))
        met = materialize(look_up(roots, n, "root", following, "_next"), "labels")
        discard(roots)
        least = materialize(met.where("_next is null").select(F.col("root").alias("id")).distinct().withColumn("component", F.col("id")), "labels")
        named = met.select("id", F.coalesce("_next", "root").alias("component"))
        labels = passed_on(named.unionByName(least).unionByName(labels), met, least, labels)
    return labels


def _sampled(edges: DataFrame, sample: int = 1024, trace: list[dict] | None = None) -> DataFrame:
    """Link the least and the greatest neighbour of each vertex, find the giant component, finish without its arcs."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    near, met = materialize_watched(both.groupBy("src").agg(F.min("dst").alias("least"), F.max("dst").alias("most"), F.count(F.lit(1)).alias("n")), "near", more=F.count_if(F.col("n") > 2))
    first = _contract(near.select("src", F.col("least").alias("dst")).unionByName(near.select("src", F.col("most").alias("dst"))))
    if trace is None and not met["more"]:
        # no vertex has an arc that is not linked
        discard(near)
        return first
    # the same vertices every time: those of least hash; a bounded sample that only chooses what is skipped
    drawn = first.orderBy(F.xxhash64("id"), "id").limit(sample).groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").head(1)
    giant = drawn[0]["component"] if drawn else None
    # an edge between the giant and another component is still read from its other end
    outside = first.where(F.col("component") != giant).join(near.where("n > 2").withColumnRenamed("src", "id"), "id").select(F.col("id").alias("src"), F.col("component").alias("a"), "least", "most")
    # an arc that is neither end's least or greatest has two ends with more than two arcs
    left = both.join(outside, "src").where("dst <> least and dst <> most")
    ends = first.where(F.col("component") != giant).select(F.col("id").alias("dst"), F.col("component").alias("b"))
    # only vertices outside are looked up: what is not among them lies in the giant, whose root is no join key
    pairs = left.join(ends, "dst", "left").select("a", F.coalesce("b", F.lit(giant)).alias("b"))
    found, seen = materialize_watched(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "finish", arcs=F.sum("n"))
    if trace is not None:
        trace.append({"giant": giant, "read": seen["arcs"] or 0, "arcs": both.count()})
    discard(near)
    joined = found.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if not joined.head(1):
        return first
    last = _contract(joined)
    # the giant's own label falls only if something beside it has a smaller one
    moved = last.where(F.col("id") == giant).head(1)
    root = moved[0]["component"] if moved else giant
    names = last.where(F.col("id") != giant).select(F.col("id").alias("_key"), F.col("component").alias("_new"))
    others = first.where(F.col("component") != giant)
    renamed = look_up(others, first.count(), "component", names, "_new").select("id", F.coalesce("_new", "component").alias("component"))
    out = materialize(renamed.unionByName(first.where(F.col("component") == giant).select("id", F.lit(root).cast("long").alias("component"))), "labels")
    discard(first, last, found)
    return out


def _propagate(edges: DataFrame, trace: list[int] | None = None) -> DataFrame:
    """Labels of the vertices that moved go along their arcs, and what they better is written as a table of its own.

    Arcs, labels and what bettered them are bucketed alike, so a superstep shuffles the labels on their way and no more.
    ``trace`` gets how many vertices moved in each superstep.
    """
    n = bucket_number(edges.sparkSession, 2 * edges.count())
    written = lambda rows, name: materialize_bucketed(rows, "id", name, n, exchange=False)
    both = written(mirrored(edges.where("src <> dst").withColumn("weight", F.lit(1))).select(F.col("src").alias("id"), "dst").repartition(n, "id").distinct(), "arcs")
    base = written(both.groupBy("id").agg(F.least(F.min("dst"), F.col("id")).alias("component")), "label")
    moved, bettered = base, []

    def latest() -> DataFrame:
        """``base`` with what bettered it; the later table has the smaller label."""
        out = base
        for i, t in enumerate(bettered):
            out = out.join(t.select("id", F.col("component").alias(f"_{i}")).hint("merge"), "id", "left")
        names = [f"_{i}" for i in reversed(range(len(bettered)))]
        return out.select("id", F.coalesce(*names, "component").alias("component"))

    while True:
        sent = both.join(moved, "id").select(F.col("dst").alias("id"), "component").repartition(n, "id").groupBy("id").agg(F.min("component").alias("_new"))
        better = latest().hint("merge").join(sent.hint("merge"), "id").where(F.col("_new") < F.col("component")).select("id", F.col("_new").alias("component"))
        moved = written(better, "moved")
        many = moved.count()
        if trace is not None:
            trace.append(many)
        if not many:
            break
        bettered.append(moved)
        if len(bettered) == 3:
            # few tables beside the labels: plans stay short, and their code is compiled once
            merged = written(latest(), "label")
            discard(base, *bettered[:-1])
            base, bettered = merged, [moved]
    out = materialize(latest(), "label")
    discard(both, base, moved, *bettered)
    return out


def connected_components(edges: DataFrame, strategy: str = "contract", **how) -> DataFrame:
    """``(id, component)`` for every vertex that has an edge; ``edges`` has long columns ``src`` and ``dst``.

    Null ends and self-loops link nothing.  No edges give no rows.  ``sampled`` takes ``sample`` (how many vertices are drawn
    to find the giant component) and ``trace``, which gets its label and how many arcs, not linked before, were read in the finish;
    ``propagate`` a ``trace`` of how many vertices moved.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    return {"contract": _contract, "sampled": _sampled, "propagate": _propagate}[strategy](edges, **how)


def component_sizes(labels: DataFrame) -> DataFrame:
    """``(component, size)`` of a labelling."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
