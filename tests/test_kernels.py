"""Kernels against plain Python on random graphs, and strategies against each other."""

import heapq
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from graphloom import Graph
from graphloom.functions.geo import estimates_to
from graphloom.graph import bucket_number
from graphloom.operators.betweenness import betweenness
from graphloom.operators.bfs import bfs, bfs_all, bfs_stats
from graphloom.operators.components import component_sizes, connected_components
from graphloom.operators.frontier import edge_map, run_rounds, same, size
from graphloom.operators.kcore import kcore, kcore_stats
from graphloom.operators.ordered import UNREACHED, astar, fill_sentinels, ppsp, sssp
from graphloom.operators.pagerank import pagerank, top_scores
from graphloom.operators.recommend import recommend, trust_circle
from graphloom.operators.triangles import _closed, _oriented, _range_width, triangle_count, worth_relabelling


def random_arcs(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), r.randint(1, 20)) for _ in range(m)]


def canonical(arcs, mirror):
    best = {}
    for u, v, w in arcs + ([(v, u, w) for u, v, w in arcs] if mirror else []):
        if u != v:
            best[u, v] = min(w, best.get((u, v), w))
    out = defaultdict(dict)
    for (u, v), w in best.items():
        out[u][v] = w
    return out


@pytest.fixture(scope="module")
def arcs():
    return random_arcs(60, 130, 4) + [(70, 70, 1), (61, 62, 3), (62, 61, 2)]


@pytest.fixture(scope="module")
def directed(spark, arcs):
    return Graph.from_tables(spark.createDataFrame(arcs, "src long, dst long, weight long"), weight="weight")


@pytest.fixture(scope="module")
def mirrored(spark, arcs):
    return Graph.from_tables(spark.createDataFrame(arcs, "src long, dst long, weight long"), weight="weight", mirror=True)


def pairs(df, *cols):
    return {r[cols[0]]: r[cols[1]] for r in df.collect()}


def dijkstra(adj, s):
    dist, heap = {s: 0}, [(0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if d == dist[u]:
            for v, w in adj[u].items():
                if d + w < dist.get(v, 1 << 60):
                    dist[v] = d + w
                    heapq.heappush(heap, (d + w, v))
    return dist


def depths(adj, s):
    d, q = {s: 0}, deque([s])
    while q:
        u = q.popleft()
        for v in adj[u]:
            if v not in d:
                d[v] = d[u] + 1
                q.append(v)
    return d


def test_model(directed, arcs):
    adj = canonical(arcs, False)
    assert directed.nodes == 71  # an id with only a loop is a vertex
    assert {(r.src, r.dst): r.weight for r in directed.edges.collect()} == {(u, v): w for u, x in adj.items() for v, w in x.items()}
    m = sum(map(len, adj.values()))
    assert directed.stats().head().asDict() == {"nodes": 71, "edges": m, "directed": True, "degree": m // 71}
    assert pairs(directed.out_degrees(), "id", "degree") == {i: len(adj[i]) for i in range(71)}
    assert {r.id for r in directed.neighbors(5).collect()} == set(adj[5])
    assert [r.id for r in directed.neighbors(5, skip=1).collect()] == sorted(adj[5])[1:]
    assert directed.pick_sources(3).count() == 3


def test_relabel(mirrored):
    deg = pairs(mirrored.out_degrees(), "id", "degree")
    order = sorted(deg, key=lambda i: (-deg[i], -i))
    assert pairs(mirrored.degree_ranks(), "id", "rank") == {i: k for k, i in enumerate(order)}
    assert pairs(mirrored.degree_ranks(width=7), "id", "rank") == {i: k for k, i in enumerate(order)}
    new = mirrored.relabel_by_degree()
    assert sorted(deg.values(), reverse=True) == [r.degree for r in new.out_degrees().orderBy("id").collect()]


def test_relabel_needs_undirected(directed):
    with pytest.raises(ValueError):
        directed.relabel_by_degree()


@pytest.mark.parametrize("strategy", ["top_down", "bottom_up"])
def test_bfs(directed, arcs, strategy):
    adj = canonical(arcs, False)
    want = depths(adj, 3)
    got = {r.id: (r.depth, r.parent) for r in bfs(directed, 3, strategy).collect()}
    assert {i: d for i, (d, _) in got.items()} == want
    for i, (d, p) in got.items():
        assert p == (3 if i == 3 else min(u for u in want if want[u] == d - 1 and i in adj[u]))
    assert pairs(bfs_all(directed, 3), "id", "parent")[70] == -1
    assert bfs_stats(directed, bfs(directed, 3)).head().asDict() == {"reached": len(want), "arcs": sum(len(adj[i]) for i in want)}


@pytest.mark.parametrize("delta,merge", [(None, 1), (1, 1), (4, 1), (4, 3)])
def test_sssp(directed, arcs, delta, merge):
    assert pairs(sssp(directed, 3, delta, merge), "id", "dist") == dijkstra(canonical(arcs, False), 3)


def test_point_to_point(directed, arcs):
    want = dijkstra(canonical(arcs, False), 3)
    goal = max(want, key=want.get)
    for delta in (None, 5):
        assert pairs(ppsp(directed, 3, goal, delta), "id", "dist") == {goal: want[goal]}
        assert ppsp(directed, 3, 70, delta).collect() == []
    back = dijkstra(canonical([(v, u, w) for u, v, w in arcs], False), goal)
    hints = directed.spark.createDataFrame([(i, back.get(i, 10_000) // 2) for i in range(71)], "id long, hint long")
    assert pairs(astar(directed, 3, goal, hints, 5), "id", "dist") == {goal: want[goal]}
    assert pairs(fill_sentinels(directed, sssp(directed, 3).withColumnRenamed("dist", "value")), "id", "value")[70] == UNREACHED


def test_estimates(spark):
    import math

    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.1), (2, 0.3, 0.0)], "id long, lat double, lon double")
    got = pairs(estimates_to(df, 0), "id", "hint")
    assert got == {0: 0, 1: math.floor(0.1 * 637_100_000.0), 2: got[2]} and abs(got[2] - 0.3 * 637_100_000.0) < 2


@pytest.mark.parametrize("strategy", ["contract", "propagate"])
def test_components(directed, arcs, strategy):
    adj = canonical(arcs, True)
    want = {}
    for i in sorted(adj):
        if i not in want:
            want |= dict.fromkeys(depths(adj, i), i)
    found = connected_components(directed.edges, strategy)
    assert pairs(found, "id", "component") == want
    assert sum(r["size"] for r in component_sizes(found).collect()) == len(want)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).collect() == []


def test_components_of_a_path(spark):
    r = random.Random(2)
    ids = list(range(200))
    r.shuffle(ids)
    rows = list(zip(ids, ids[1:]))
    assert set(pairs(connected_components(spark.createDataFrame(rows, "src long, dst long")), "id", "component").values()) == {0}


def plain_rank(adj, n, rounds):
    x = [1 / n] * n
    for _ in range(rounds):
        new = [0.15 / n] * n
        for u in range(n):
            for v in adj[u]:
                new[v] += 0.85 * x[u] / len(adj[u])
        x = new
    return x


def test_pagerank(directed, arcs):
    want = plain_rank(canonical(arcs, False), 71, 6)
    got = pairs(pagerank(directed, 6, 0.0), "id", "score")
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(71))
    settled = pairs(pagerank(directed, 100, 1e-9), "id", "score")
    far = plain_rank(canonical(arcs, False), 71, 100)
    assert all(abs(settled[i] - far[i]) < 1e-8 for i in range(71))
    assert [r.id for r in top_scores(pagerank(directed, 6, 0.0), 3).collect()] == sorted(range(71), key=lambda i: (-want[i], -i))[:3]


def test_betweenness(directed, arcs):
    adj = canonical(arcs, False)
    want = [0.0] * 71
    for s in (3, 9):
        d = depths(adj, s)
        paths, share = defaultdict(float, {s: 1.0}), defaultdict(float)
        for u in sorted(d, key=d.get):
            for v in adj[u]:
                if d[v] == d[u] + 1:
                    paths[v] += paths[u]
        for u in sorted(d, key=d.get, reverse=True):
            for v in adj[u]:
                if d[v] == d[u] + 1:
                    share[u] += paths[u] / paths[v] * (1 + share[v])
            want[u] += share[u]
    sources = directed.vertices().where("id in (3, 9)")
    got = pairs(betweenness(directed, sources, normalized=False), "id", "score")
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(71))
    scaled = pairs(betweenness(directed, sources), "id", "score")
    assert max(scaled.values()) == 1.0
    assert set(pairs(betweenness(directed, directed.vertices().where("id = 70")), "id", "score").values()) == {0.0}


def test_segments(mirrored):
    found = mirrored.segments(7).collect()
    assert len(found) == mirrored.edges.count() and all(r.segment == r.dst // 7 for r in found)
    assert all(r.segment == r.src // 5 for r in mirrored.segments(5, "src").collect())


def test_triangles(mirrored, directed, arcs):
    adj = canonical(arcs, True)
    want = sum(1 for u in adj for v in adj[u] if u < v for w in adj[v] if v < w and w in adj[u])
    for strategy in ("wedge", "intersect"):
        for order in ("degree", "id", "auto"):
            assert triangle_count(mirrored, strategy, order).head()[0] == want
    assert triangle_count(mirrored, "segments", "id", width=7).head()[0] == want
    assert triangle_count(mirrored, "segments", "degree", width=100).head()[0] == want
    with pytest.raises(ValueError):
        triangle_count(mirrored, "none")
    assert worth_relabelling(mirrored) is False
    with pytest.raises(ValueError):
        triangle_count(directed)


def test_triangles_send_a_row_for_an_arc_not_for_a_pair(spark):
    n = 24
    full = Graph.from_tables(spark.createDataFrame([(a, b) for a in range(n) for b in range(a)], "src long, dst long"), mirror=True)
    for width in (None, 5):
        met = _closed(_oriented(full, "degree"), width, None)
        assert met.agg(F.sum("n")).head()[0] == n * (n - 1) * (n - 2) // 6
        assert met.count() <= n * (n - 1) // 2 * (1 if width is None else -(-n // width))
    e = _oriented(full, "id")
    assert _range_width(e, n, 30) == 30 and _range_width(e, 1000, 30) == 1000 and _range_width(e, 1000, 5) < n


def test_a_table_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = spark.createDataFrame(spark.sparkContext.parallelize([(i, i + 1, 2) for i in range(50)] + [(90, 90, 1), (None, 3, 1)]).map(seen), "src long, dst long, weight long")
    g = Graph.from_tables(rows, weight="weight", mirror=True)
    assert (g.nodes, g.cache().edges.count(), g.out_degrees().count()) == (91, 100, 91)
    assert read.value == 52


def test_large_tables_get_more_buckets(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bucket_number(spark, 0) == least and bucket_number(spark, 500 << 21) == 500
    rows = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    g = Graph.from_tables(rows, rows=(least + 2) << 21)
    told = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {g.by_src()._graphloom_table}").collect()}
    assert g.buckets == least + 2 == int(told["Num Buckets"])


def test_kcore(mirrored, directed, arcs):
    adj = canonical(arcs, True)
    deg, core, k = {i: len(adj[i]) for i in range(71)}, {}, 0
    while deg:
        i = min(deg, key=lambda x: (deg[x], x))
        k = max(k, deg.pop(i))
        core[i] = k
        for j in adj[i]:
            if j in deg:
                deg[j] -= 1
    for strategy in ("hindex", "peel"):
        assert pairs(kcore(mirrored, strategy), "id", "coreness") == core
    assert kcore_stats(kcore(mirrored)).head().asDict() == {"max_coreness": max(core.values()), "sum_coreness": sum(core.values())}
    with pytest.raises(ValueError):
        kcore(directed)


def test_recommend(spark):
    trust = Graph.from_tables(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (2, 0), (5, 6)], "src long, dst long"))
    rates = Graph.from_tables(spark.createDataFrame([(0, 10, 5), (1, 10, 4), (2, 10, 3), (3, 11, 4), (1, 12, 4), (4, 13, 5)], "src long, dst long, weight long"), weight="weight")
    assert {r.id for r in trust_circle(trust, 0).collect()} == {0, 1, 2, 3}  # 0 lies on a circle of three steps
    assert {r.id for r in trust_circle(trust, 5).collect()} == {6}
    assert [tuple(r) for r in recommend(trust, rates, 0).collect()] == [(10, 2), (12, 1), (11, 1)]
    assert [tuple(r) for r in recommend(trust, rates, 0, pad=True).collect()] == [(10, 2), (12, 1), (11, 1), (0, 0), (0, 0)]


def test_frontier(directed, arcs):
    adj = canonical(arcs, False)
    front = directed.vertices().where("id < 5")
    want = defaultdict(int)
    for u in range(5):
        for v, w in adj[u].items():
            want[v] = max(want[v], w)
    got = edge_map(directed, front, update=lambda df: df["weight"], combine=F.max, cond=directed.vertices().where("id > 2"))
    assert pairs(got, "id", "value") == {v: w for v, w in want.items() if v > 2}
    assert size(front) == 5 and same(front, directed.vertices().where("id <= 4")) and not same(front, directed.vertices())
    last = run_rounds(front, lambda f, i: f.where(f"id > {i}").select("id"))
    assert [r.id for r in last.collect()] == [4]
