"""One small graph in seven encodings, and known results on it."""

import pytest
from pyspark.sql import functions as F

from graphloom import Graph
from graphloom.operators.betweenness import betweenness
from graphloom.operators.bfs import bfs
from graphloom.operators.components import connected_components
from graphloom.operators.kcore import kcore, kcore_stats
from graphloom.operators.ordered import sssp
from graphloom.operators.pagerank import pagerank
from graphloom.operators.triangles import triangle_count
from graphloom.sources.readers import read_graph

#: The arcs (target: weight) of each vertex.
ARCS = {
    0: {1: 19, 2: 5, 3: 1, 4: 8, 6: 67, 7: 18, 8: 11, 9: 3, 10: 93, 11: 2, 12: 38, 13: 6},
    2: {1: 40, 4: 167, 6: 199, 9: 22, 10: 47},
    3: {2: 250, 4: 183, 9: 204, 12: 130, 13: 121},
    4: {6: 176},
    7: {1: 39, 2: 13, 3: 251, 4: 155, 9: 101, 10: 58, 11: 72, 12: 15, 13: 75},
    8: {1: 45, 2: 29, 3: 23, 4: 245, 7: 25, 9: 112, 11: 205, 12: 26, 13: 23},
    9: {1: 115, 4: 19, 6: 53, 10: 141, 11: 139},
    10: {1: 181},
    12: {1: 213},
    13: {2: 243, 4: 29, 9: 59, 10: 212, 11: 200},
}
ROWS = [(u, v, w) for u, near in ARCS.items() for v, w in near.items()]
#: Known results.
DEPTHS_8 = {1: 1, 2: 1, 3: 1, 4: 1, 6: 2, 7: 1, 8: 0, 9: 1, 10: 2, 11: 1, 12: 1, 13: 1}
DISTANCES = {
    0: {0: 0, 1: 19, 2: 5, 3: 1, 4: 8, 6: 56, 7: 18, 8: 11, 9: 3, 10: 52, 11: 2, 12: 33, 13: 6},
    8: {1: 45, 2: 29, 3: 23, 4: 52, 6: 104, 7: 25, 8: 0, 9: 51, 10: 76, 11: 97, 12: 26, 13: 23},
    13: {1: 174, 2: 243, 4: 29, 6: 112, 9: 59, 10: 200, 11: 198, 13: 0},
}
RANKS = [0.010714, 0.053332, 0.018812, 0.013743, 0.025752, 0.010714, 0.040303, 0.012557, 0.011473, 0.022011, 0.022332, 0.020218, 0.016079, 0.016079]
CORENESS = {0: 7, 1: 6, 2: 7, 3: 7, 4: 7, 5: 0, 6: 4, 7: 7, 8: 7, 9: 7, 10: 6, 11: 5, 12: 5, 13: 7}


def lines(kind):
    doubled = ROWS + [(u, v, w + 1) for u, v, w in ROWS[::3]] + [(i, i, 5) for i in range(14)]
    near = [[(v + 1, w) for v, w in ARCS.get(u, {}).items()] for u in range(14)]
    return {
        "el": [f"{u} {v}" for u, v, _ in doubled],
        "wel": [f"{u} {v} {w}" for u, v, w in doubled],
        "gr": ["c a comment", f"p sp 14 {len(doubled)}", *(f"a {u} {v} {w}" for u, v, w in doubled)],
        "graph": ["14 53 100", *(" ".join(str(v) for v, _ in x) for x in near)],
        "w.graph": ["% a comment", "14 53 1", *(" ".join(f"{v} {w}" for v, w in x) for x in near)],
        "mtx": ["%%MatrixMarket matrix coordinate pattern general", f"14 14 {len(doubled)}", *(f"{u + 1} {v + 1}" for u, v, _ in doubled)],
        "w.mtx": ["%%MatrixMarket matrix coordinate integer general", "% a comment", f"14 14 {len(doubled)}", *(f"{u + 1} {v + 1} {w}" for u, v, w in doubled)],
    }[kind]


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.from_tables(spark.createDataFrame(ROWS, "src long, dst long, weight long"), weight="weight", nodes=14).cache()


def pairs(df, *cols):
    return {r[cols[0]]: r[cols[1]] for r in df.collect()}


@pytest.mark.parametrize("kind", ["el", "wel", "gr", "graph", "w.graph", "mtx", "w.mtx"])
def test_encodings(spark, tmp_path, kind):
    path = tmp_path / f"g.{kind}"
    path.write_text("\n".join(lines(kind)) + "\n")
    g = read_graph(spark, str(path))
    plain = kind in ("el", "graph", "mtx")
    assert g.stats().head().asDict() == {"nodes": 14, "edges": 53, "directed": True, "degree": 3}
    assert {(r.src, r.dst, r.weight) for r in g.edges.collect()} == {(u, v, 1 if plain else w) for u, v, w in ROWS}


def test_directed(graph):
    assert [graph.out_degrees().orderBy("id").collect()[i].degree for i in (0, 1, 7, 8, 13)] == [12, 0, 9, 9, 5]
    assert pairs(bfs(graph, 8), "id", "depth") == DEPTHS_8
    assert {i: p for i, p in pairs(bfs(graph, 8), "id", "parent").items() if p != 8} == {6: 2, 10: 2}
    for source, want in DISTANCES.items():
        assert pairs(sssp(graph, source), "id", "dist") == want
    assert set(pairs(connected_components(graph.edges), "id", "component").values()) == {0}
    got = pairs(pagerank(graph, 20, 0.0), "id", "score")
    assert all(abs(got[i] - x) < 1e-6 for i, x in enumerate(RANKS)) and abs(sum(got.values()) - 0.294120) < 1e-6
    for source, want in ((8, {2: 0.583333, 4: 0.333333, 7: 0.25, 8: 11, 9: 0.583333, 13: 0.25}), (13, {2: 0.666667, 4: 0.333333, 9: 0.666667, 10: 0.333333, 13: 7})):
        scores = pairs(betweenness(graph, graph.vertices().where(F.col("id") == source), normalized=False), "id", "score")
        assert all(abs(scores[i] - want.get(i, 0)) < 1e-6 for i in range(14))


def test_undirected(graph):
    both = graph.undirected()
    both.nodes = 14
    assert both.stats().head()["edges"] == 53
    assert triangle_count(both).head()[0] == 105
    cores = kcore(both)
    assert pairs(cores, "id", "coreness") == CORENESS
    assert kcore_stats(cores).head().asDict() == {"max_coreness": 7, "sum_coreness": 82}
