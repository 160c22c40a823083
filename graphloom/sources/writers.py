"""Graph sinks and conversion between formats."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, bucket_number
from graphloom.sources.binary import GEO_MAGIC, GEO_RADIUS_CM, index_of
from graphloom.sources.parts import assemble, pack_groups, pack_sorted, parts_folder
from graphloom.sources.readers import FormatError, read_graph, suffix


def in_order(rows: DataFrame, many: int, *by: str) -> DataFrame:
    """``rows`` (about ``many``) sorted by ranges, of which large tables have more."""
    return rows.repartitionByRange(bucket_number(rows.sparkSession, many), *by).sortWithinPartitions(*by)


def write_edge_list(graph: Graph, path: str, weighted: bool = False) -> None:
    """A folder of text files with ``u v [w]`` lines, one for each stored arc."""
    graph.edges.select(F.concat_ws(" ", *["src", "dst", *["weight"] * weighted]).alias("value")).write.mode("overwrite").text(path)


def text_lines(graph: Graph, kind: str) -> DataFrame:
    """``at, src, dst, line``: a graph as lines of a text format, in an order by the first three columns."""
    spark, m = graph.spark, graph.arcs()

    def lines(at: int, rows: DataFrame, line: Column, src: str = "src", dst: str | Column = "dst") -> DataFrame:
        return rows.select(F.lit(at).alias("at"), F.col(src).cast("long").alias("src"), (F.col(dst) if isinstance(dst, str) else dst).cast("long").alias("dst"), line.cast("string").alias("line"))

    none = F.lit(0)
    head = {
        "gr": [f"c {m} arcs", f"p sp {graph.nodes} {m}"],
        "graph": ["% weighted", f"{graph.nodes} {m} 1"],
        "mtx": ["%%MatrixMarket matrix coordinate integer general", "% arcs", f"{graph.nodes} {graph.nodes} {m}"],
        "adj": ["WeightedAdjacencyGraph", str(graph.nodes), str(m)],
    }[kind]
    out = spark.createDataFrame([(i, 0, 0, x) for i, x in enumerate(head)], "at int, src long, dst long, line string")
    if kind == "gr":
        return out.unionByName(lines(9, graph.edges, F.concat_ws(" ", F.lit("a"), "src", "dst", "weight")))
    if kind == "mtx":
        return out.unionByName(lines(9, graph.edges, F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, "weight")))
    if kind == "graph":
        near = graph.edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct((F.col("dst") + 1).alias("v"), "weight"))).alias("near"))
        text = F.concat_ws(" ", F.transform("near", lambda x: F.concat_ws(" ", x["v"], x["weight"])))
        return out.unionByName(lines(9, graph.vertices().join(near, F.col("id") == F.col("src"), "left"), F.coalesce(text, F.lit("")), "id", none))
    parts = lines(7, graph.vertex_offsets(), F.col("offset"), "id", none).unionByName(lines(8, graph.edges, F.col("dst"))).unionByName(lines(9, graph.edges, F.col("weight")))
    return out.unionByName(parts)


def write_text(graph: Graph, path: str, kind: str) -> None:
    """``.gr``, ``.graph``, ``.mtx`` or ``.adj``: a folder of text files that follow on each other by name, sorted by ranges."""
    in_order(text_lines(graph, kind), graph.nodes + 2 * graph.arcs(), "at", "src", "dst").select("line").write.mode("overwrite").text(path)


def write_serialized(graph: Graph, path: str, weighted: bool = False) -> None:
    """One ``.sg`` / ``.wsg`` file; arcs and offsets are sorted and packed in parts (see ``graphloom.sources.parts``)."""
    folder = parts_folder(graph.spark)
    cell = [("dst", "<i4"), ("weight", "<i4")] if weighted else [("dst", "<i4")]
    arcs = graph.arcs()

    def arrays(g: Graph) -> list[bytes | DataFrame]:
        # an offset for each vertex, and the end of the last
        return [pack_sorted(in_order(g.vertex_offsets(), g.nodes, "id"), [("offset", "<i8")], folder), np.array([arcs], "<i8").tobytes(), pack_sorted(in_order(g.edges, arcs, "src", "dst"), cell, folder)]

    head = np.array([graph.directed], np.uint8).tobytes() + np.array([arcs, graph.nodes], "<i8").tobytes()
    assemble(graph.spark, [head, *arrays(graph), *(arrays(graph.reverse()) if graph.directed else [])], path, folder)


def write_binary_adjacency(graph: Graph, path: str, weighted: bool = True) -> None:
    """``x.config`` with the number of vertices, and beside it ``x.adj`` (targets, with weights) and ``x.idx`` (offsets)."""
    stem, spark = path.removesuffix(".config"), graph.spark
    cell = [("dst", "<u4"), ("weight", "<i4")] if weighted else [("dst", "<u4")]
    for name, rows, kind in (("adj", in_order(graph.edges, graph.arcs(), "src", "dst"), cell), ("idx", in_order(graph.vertex_offsets(), graph.nodes, "id"), [("offset", "<i8")])):
        folder = parts_folder(spark)
        assemble(spark, [pack_sorted(rows, kind, folder)], f"{stem}.{name}", folder)
    assemble(spark, [f"{graph.nodes}\n".encode()], path, parts_folder(spark))


def _records(table: pa.Table) -> bytes:
    """Geo records of a run of vertices: place, degree, targets, angles."""
    rows = sorted(table.select(["id", "lat", "lon", "near"]).to_pylist(), key=lambda r: r["id"])
    out = []
    for r in rows:
        near = sorted((x["dst"], x["weight"]) for x in r["near"] or ())
        # half a centimetre more, so that cutting to whole ones gives the weight back
        out += [struct.pack("<ddI", r["lat"], r["lon"], len(near)), np.array([d for d, _ in near], "<u4").tobytes(), ((np.array([w for _, w in near], "<f8") + 0.5) / GEO_RADIUS_CM).tobytes()]
    return b"".join(out)


def write_geo(graph: Graph, places: DataFrame, path: str, vertices_each: int = 1 << 16) -> None:
    """One geo file of a graph whose weights are centimetres, and its vertices' ``places`` (id, lat, lon in radians; 0 where there is none).

    Runs of ``vertices_each`` vertices are packed by tasks.  Where each of them begins is written beside the file, as a
    table at ``<path>.index``, with which it is read without a pass over all of it.
    """
    spark, folder = graph.spark, parts_folder(graph.spark)
    near = graph.edges.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct("dst", "weight")).alias("near"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    rows = graph.vertices().join(places.select("id", "lat", "lon"), "id", "left").join(near, "id", "left").select("id", zero("lat"), zero("lon"), "near", F.expr(f"id div {vertices_each}").alias("run"))
    parts = pack_groups(rows, "run", _records, folder)
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 8
    index = parts.select((F.col("seq") * vertices_each).alias("first"), F.least(F.lit(vertices_each), graph.nodes - F.col("seq") * vertices_each).cast("long").alias("count"), before.alias("offset"), (before + F.col("bytes")).alias("stop"))
    index.write.mode("overwrite").parquet(index_of(path))
    assemble(spark, [struct.pack("<II", GEO_MAGIC, graph.nodes), parts], path, folder)


def write_graph(graph: Graph, path: str, format: str | None = None) -> None:
    """Dispatch by ``format`` or suffix: el, wel, gr, graph, mtx, adj, config, sg, wsg, parquet.  For geo files see ``write_geo``."""
    kind = format or suffix(path)
    if kind in ("el", "wel"):
        write_edge_list(graph, path, kind == "wel")
    elif kind in ("gr", "graph", "mtx", "adj"):
        write_text(graph, path, kind)
    elif kind in ("sg", "wsg"):
        write_serialized(graph, path, kind == "wsg")
    elif kind == "config":
        write_binary_adjacency(graph, path)
    elif kind == "parquet":
        graph.edges.write.mode("overwrite").parquet(path)
    else:
        raise FormatError(f"cannot write format {kind}")


def convert(spark: SparkSession, source: str, target: str, source_format: str | None = None, target_format: str | None = None, mirror: bool = False, **options) -> Graph:
    """Read, canonicalize and write; the graph that was read."""
    graph = read_graph(spark, source, source_format, mirror, **options)
    write_graph(graph, target, target_format)
    return graph
