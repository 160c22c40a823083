"""Readers, writers and generators."""

import struct

import numpy as np
import pytest

from graphloom import Graph
from graphloom.sources.binary import _arcs_of, coordinates, open_fs, read_binary_adjacency, read_geo, read_serialized
from graphloom.sources.generators import kronecker, random_weights, uniform
from graphloom.sources.readers import FormatError, largest_node, read_edge_list, read_graph
from graphloom.sources.writers import convert, write_graph

ARCS = {(0, 1, 5), (0, 2, 3), (1, 2, 4), (3, 0, 7)}


def arcs(graph):
    return {(r.src, r.dst, r.weight) for r in graph.edges.collect()}


def plain(rows):
    return {(u, v, 1) for u, v, _ in rows}


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text) if isinstance(text, str) else p.write_bytes(text)
    return str(p)


def test_text_formats(spark, tmp_path):
    el = put(tmp_path, "a.el", "0 1 9\n 0\t2\n1 2\n3 0\n3 3\n0 1\n\n")
    wel = put(tmp_path, "a.wel", "0 1 5.9\n0 2 3\n1 2 4\n3 0 7\n0 1 8\n2 2 1\n")
    gr = put(tmp_path, "a.gr", "c comment\np sp 4 4\na 0 1 5\na 0 2 3\na 1 2 4\na 3 0 7\n")
    metis = put(tmp_path, "a.graph", "% first\n4 4 1\n2 5 3 3\n% inner\n3 4\n\n1 7\n")
    bare = put(tmp_path, "b.graph", "4 4\n2 3\n3\n\n1\n")
    mtx = put(tmp_path, "a.mtx", "%%MatrixMarket matrix coordinate integer general\n% c\n4 4 4\n1 2 5\n1 3 3\n2 3 4\n4 1 7\n")
    adj = put(tmp_path, "a.adj", "WeightedAdjacencyGraph\n4\n4\n0\n2\n3\n3\n1\n2\n2\n0\n5\n3\n4\n7\n")
    for path in (wel, gr, metis, mtx, adj):
        g = read_graph(spark, path)
        assert arcs(g) == ARCS and g.nodes == 4, path
    for path in (el, bare):
        assert arcs(read_graph(spark, path)) == plain(ARCS)
    assert arcs(read_graph(spark, gr, one_based=True)) == {(-1 + u, -1 + v, w) for u, v, w in ARCS}
    assert largest_node(read_edge_list(spark, el)).head().asDict() == {"max_src": 3, "max_dst": 3}


def test_matrix_kinds(spark, tmp_path):
    sym = put(tmp_path, "s.mtx", "%%MatrixMarket matrix coordinate real symmetric\n3 3 2\n2 1 2.5\n3 1 -1.5\n")
    assert arcs(read_graph(spark, sym)) == {(1, 0, 2), (0, 1, 2), (2, 0, -1), (0, 2, -1)}
    pattern = put(tmp_path, "p.mtx", "%%MatrixMarket matrix coordinate pattern general\n3 3 2\n2 1\n3 1\n")
    assert arcs(read_graph(spark, pattern)) == {(1, 0, 1), (2, 0, 1)}
    for text in ("%%MatrixMarket matrix array real general\n3 3\n", "%%MatrixMarket matrix coordinate complex general\n3 3 0\n", "%%MatrixMarket matrix coordinate real general\n3 4 0\n", "no banner\n"):
        with pytest.raises(FormatError):
            read_graph(spark, put(tmp_path, "bad.mtx", text))
    with pytest.raises(FormatError):
        read_graph(spark, put(tmp_path, "x.graph", "3 2 11\n"))
    with pytest.raises(FormatError):
        read_graph(spark, put(tmp_path, "nosuffix", ""))
    with pytest.raises(FormatError):
        read_graph(spark, put(tmp_path, "a.xyz", ""))


@pytest.mark.parametrize("mirror", [False, True])
def test_serialized(spark, tmp_path, mirror):
    rows = spark.createDataFrame(sorted(ARCS) + [(6, 6, 1)], "src long, dst long, weight long")
    g = Graph.from_tables(rows, weight="weight", mirror=mirror)
    for kind in ("wsg", "sg"):
        path = str(tmp_path / f"g.{kind}")
        write_graph(g, path)
        back = read_graph(spark, path)
        assert (back.nodes, back.directed) == (7, not mirror)
        assert arcs(back) == (arcs(g) if kind == "wsg" else plain(arcs(g)))
    raw = (tmp_path / "g.sg").read_bytes()
    n = g.edges.count()
    assert len(raw) == 17 + (1 if mirror else 2) * (8 * 8 + 4 * n)


def test_convert(spark, tmp_path):
    source = put(tmp_path, "a.wel", "0 1 5\n0 2 3\n1 2 4\n3 0 7\n")
    for target in ("b.wel", "b.wsg", "b.parquet"):
        convert(spark, source, str(tmp_path / target))
        assert arcs(read_graph(spark, str(tmp_path / target))) == ARCS
    with pytest.raises(FormatError):
        convert(spark, source, str(tmp_path / "b.xyz"))


def test_geo(spark, tmp_path):
    body = struct.pack("<II", 0x150842A7, 2) + struct.pack("<ddI", 0.1, 0.2, 1) + struct.pack("<I", 1) + struct.pack("<d", 1e-6) + struct.pack("<ddI", 0.3, 0.4, 0)
    path = put(tmp_path, "g.bin", body)
    assert [tuple(r) for r in read_geo(spark, path)[0].collect()] == [(0, 1, 637)]
    assert [tuple(r) for r in coordinates(spark, path).collect()] == [(0, 0.1, 0.2), (1, 0.3, 0.4)]
    assert arcs(read_graph(spark, path)) == {(0, 1, 637)}


def test_binary_adjacency(spark, tmp_path):
    config, idx = put(tmp_path, "c.config", "4\n"), put(tmp_path, "c.idx", np.array([0, 2, 3, 3], "<i8").tobytes())
    plain_file = put(tmp_path, "c.adj", np.array([1, 2, 2, 0], "<u4").tobytes())
    assert {tuple(r) for r in read_binary_adjacency(spark, config, plain_file, idx).collect()} == plain(ARCS)


def test_generators(spark):
    assert kronecker(spark, 10).stats().head().asDict() == {"nodes": 1024, "edges": 10496, "directed": False, "degree": 10}
    assert uniform(spark, 10).stats().head().asDict() == {"nodes": 1024, "edges": 16104, "directed": False, "degree": 15}
    g = random_weights(uniform(spark, 6, 4))
    w = {(r.src, r.dst): r.weight for r in g.edges.collect()}
    assert all(w[u, v] == w[v, u] and 1 <= w[u, v] <= 255 for u, v in w) and len(set(w.values())) > 30


def test_arcs_are_dealt_and_not_vertices(spark, tmp_path):
    """A task of a binary file reads so many arcs, however many a vertex has."""
    rows = [(3, v, v % 5 + 1) for v in range(40) if v != 3] + [(9, 1, 2), (9, 4, 2), (20, 3, 7), (59, 0, 1)]
    g = Graph.from_tables(spark.createDataFrame(rows, "src long, dst long, weight long"), weight="weight")
    for kind in ("config", "wsg"):
        write_graph(g, f"file://{tmp_path}/g.{kind}")
    files = [f"file://{tmp_path}/g.{x}" for x in ("config", "adj", "idx")]
    for edges in (read_binary_adjacency(spark, *files, weighted=True, arcs_each=7), read_serialized(spark, f"file://{tmp_path}/g.wsg", True, arcs_each=7).edges):
        assert sorted(map(tuple, edges.collect())) == sorted(rows)
        assert edges.rdd.glom().map(len).max() == 7
    cell = np.dtype([("dst", "<u4"), ("weight", "<i4")])
    fs, index, table = *open_fs(files[2]), open_fs(files[1])[1]
    for low in range(len(rows)):
        for high in (low + 1, (low + len(rows) + 1) // 2, len(rows)):
            met = [b.to_pylist() for b in _arcs_of(fs, (index, 0), 60, (table, 0), cell, len(rows), low, high, vertices=4, rows=5)]
            assert all(len(b) <= 5 for b in met)
            assert [(r["src"], r["dst"], r["weight"]) for b in met for r in b] == sorted(rows)[low:high]
