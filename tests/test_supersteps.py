"""Plans chosen while a search runs, its predicates and certificates, sampled and streamed components, many sources, sinks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_kernels import canonical, dijkstra, pairs, random_arcs

from graphloom import Graph
from graphloom.operators import components
from graphloom.operators import recommend as recommend_module
from graphloom.operators.bfs import Direction, bfs
from graphloom.operators.components import connected_components, look_up
from graphloom.operators.frontier import edge_map
from graphloom.operators.kcore import kcore
from graphloom.operators.ordered import fused_rounds, ordered_process, ppsp, search, sssp
from graphloom.operators.recommend import circle_bits, recommend, recommend_many, trust_circle, trust_circles
from graphloom.operators.verify import verify_bfs, verify_ppsp, verify_recommendation
from graphloom.sources.binary import index_of, read_geo
from graphloom.sources.readers import read_graph
from graphloom.sources.writers import write_geo, write_graph
from graphloom.streaming.components import StreamingComponents, stream_components

ARCS = random_arcs(60, 150, 9) + [(70, 71, 2), (71, 72, 0), (72, 71, 0)]


def graph(spark, arcs, mirror):
    return Graph.from_tables(spark.createDataFrame(arcs, "src long, dst long, weight long"), weight="weight", mirror=mirror)


@pytest.fixture(scope="module")
def directed(spark):
    return graph(spark, ARCS, False).cache()


@pytest.fixture(scope="module")
def mirrored(spark):
    return graph(spark, ARCS, True).cache()


def labels(arcs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v, *_ in arcs:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


# --- directions


@pytest.mark.parametrize("kind", ["directed", "mirrored"])
def test_hybrid_search(kind, request):
    g, trace = request.getfixturevalue(kind), []
    want = sorted(map(tuple, bfs(g, 1).collect()))
    assert sorted(map(tuple, bfs(g, 1, "hybrid", trace=trace).collect())) == want
    assert {t["direction"] for t in trace} == {"top_down", "bottom_up"} and sum(t["size"] for t in trace) == len(want)
    assert verify_bfs(g, 1, bfs(g, 1, "hybrid", alpha=1_000_000))
    assert bfs(g, 69, "hybrid").count() == 1


def test_direction_turns():
    turn = Direction(1000)
    assert [turn.choose(*x) for x in [(1, 5, 10_000), (50, 900, 9_000), (500, 5_000, 4_000), (100, 900, 900), (50, 400, 100)]] == ["top_down", "bottom_up", "bottom_up", "bottom_up", "top_down"]


def test_edge_map_directions(mirrored):
    front, cond = mirrored.vertices().where("id % 2 = 0"), mirrored.vertices().where("id % 3 = 0")
    maps = {way: sorted(map(tuple, edge_map(mirrored, front, combine=F.sum, cond=cond, direction=way).collect())) for way in ("push", "pull", "auto")}
    assert maps["push"] == maps["pull"] == maps["auto"] != []
    trace = []
    edge_map(mirrored, front, direction="auto", trace=trace)
    edge_map(mirrored, front.where("id = 0"), direction="auto", threshold=1000, trace=trace)
    assert [t["direction"] for t in trace] == ["pull", "push"]


# --- ordered processing


@pytest.mark.parametrize("delta", [None, 3])
@pytest.mark.parametrize("rounds", [3, "auto"])
def test_fused_distances(directed, delta, rounds):
    assert pairs(sssp(directed, 1, delta=delta, rounds=rounds), "id", "dist") == dijkstra(canonical(ARCS, False), 1)


def test_fusion_writes_fewer_tables(spark):
    line = graph(spark, [(i, i + 1, 1) for i in range(15)], False)
    plain, fused = [], []
    assert sssp(line, 0, trace=plain).count() == sssp(line, 0, rounds="auto", trace=fused).count() == 16
    assert len(plain) == 16 and len(fused) <= len(plain) // 3
    assert fused_rounds(1, 60, 100_000) == 2 and fused_rounds(10**6, 60, 100_000) == 1 and fused_rounds(1, 1, 10**9) == 8


def test_own_predicates(directed):
    want = dijkstra(canonical(ARCS, False), 1)
    start = directed.vertices().where("id = 1").select("id", F.lit(0).cast("long").alias("value"))
    near = ordered_process(directed, start, stop=lambda p: p.low > 12, extend=lambda p: F.col("key") < 12, delta=4)
    assert {k: v for k, v in pairs(near, "id", "value").items() if v <= 12} == {k: v for k, v in want.items() if v <= 12}
    # the nearest vertex of several, by what is watched
    goals = [k for k in want if k % 7 == 0 and k != 1]
    seen = []
    expression = F.when(F.col("id").isin(goals), F.struct("key", "id"))
    stop = lambda p: seen.append(p.watched["goal"]) or (p.watched["goal"] is not None and p.low >= p.watched["goal"]["key"])
    ordered_process(directed, start, delta=2, watch={"goal": expression}, stop=stop).count()
    assert (seen[-1]["key"], seen[-1]["id"]) == min((want[k], k) for k in goals)


@pytest.mark.parametrize("dest", [17, 69])
def test_certificates(directed, dest):
    want = dijkstra(canonical(ARCS, False), 1).get(dest)
    assert pairs(ppsp(directed, 1, dest, delta=2, rounds=2), "id", "dist").get(dest) == want
    met = search(directed, 1, dest, delta=2)
    assert verify_ppsp(directed, 1, dest, want, met)
    for wrong in ([0] if want is None else [want - 1, want + 1, None]):
        assert not verify_ppsp(directed, 1, dest, wrong, met)
        claimed = met.where(F.col("id") != dest)
        if wrong is not None:
            claimed = claimed.unionByName(directed.spark.createDataFrame([(dest, wrong)], "id long, dist long"))
        assert not verify_ppsp(directed, 1, dest, wrong, claimed)


def test_certificate_over_steps_of_no_length(directed):
    assert verify_ppsp(directed, 70, 72, 2, search(directed, 70, 72))


# --- components


def test_sampled_components(spark):
    rng = random.Random(3)
    for n, m in ((200, 400), (300, 100), (3, 0)):
        arcs = random_arcs(n, m, rng.randrange(100))
        trace = []
        df = spark.createDataFrame(arcs or [], "src long, dst long, weight long")
        got = pairs(connected_components(df, "sampled", sample=50, trace=trace), "id", "component")
        want = labels([a for a in arcs if a[0] != a[1]])
        assert got == want and trace[0]["read"] <= trace[0]["arcs"]
    # the giant's label is not its own least neighbour's until the finish
    ring = [(i, i + 1) for i in range(10, 60)] + [(40, 2), (2, 1), (1, 3)]
    assert pairs(connected_components(spark.createDataFrame(ring, "src long, dst long"), "sampled", sample=8), "id", "component") == labels(ring)


def test_star_has_no_hot_key(spark):
    rows = spark.range(1, 5001).select(F.col("id"), F.lit(0).cast("long").alias("parent"))
    table = spark.createDataFrame([(0, 7), (5, 8)], "_key long, top long")
    met = look_up(rows, 5000, "parent", table, "top", small=10)
    assert met.count() == 5000 and met.where("top = 7").count() == 5000
    parts = met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0]
    assert parts <= 5000 // 4
    assert connected_components(rows.select(F.col("id").alias("src"), F.col("parent").alias("dst"))).where("component = 0").count() == 5001


def test_linked_arcs_are_not_read_again(spark):
    ids = random.Random(4).sample(range(300), 60)
    # no vertex of a path has an arc beside those to its least and greatest neighbour; the second path lies outside the giant
    for arcs, read in ([*zip(ids, ids[1:]), (500, 502), (502, 501)], 0), ([(i, 1000 + j) for i in ids[:9] for j in range(5)], None):
        trace = []
        df = spark.createDataFrame(arcs, "src long, dst long")
        assert pairs(connected_components(df, "sampled", sample=8, trace=trace), "id", "component") == labels(arcs)
        assert pairs(connected_components(df, "sampled", sample=8), "id", "component") == labels(arcs)
        assert read is None or trace[0]["read"] == read


def test_settled_rows_stay_where_they_are(spark, monkeypatch):
    ids = random.Random(6).sample(range(400), 400)
    written = Counter()

    def counted(plain):
        def write(df, name="step", **watched):
            out = plain(df, name, **watched)
            written[name] += (out[0] if watched else out).count()
            return out

        return write

    for name in ("materialize", "materialize_watched"):
        monkeypatch.setattr(components, name, counted(getattr(components, name)))
    arcs = list(zip(ids, ids[1:]))
    assert pairs(connected_components(spark.createDataFrame(arcs, "src long, dst long")), "id", "component") == labels(arcs)
    # a vertex is named in one round, and jumps only until it is at its root
    assert written["labels"] == 400 and written["flatten"] < 2 * written["hook"]


@pytest.mark.parametrize("compact", [0, 2])
def test_batches_in_any_order(spark, tmp_path, compact):
    arcs = [(u, v) for u, v, _ in random_arcs(80, 70, 5)] + [(90, 90)]
    want = labels(arcs)
    random.Random(compact).shuffle(arcs)
    state = StreamingComponents(spark, f"file://{tmp_path}/state", compact)
    for i, batch in enumerate([arcs[0::3], arcs[1::3], arcs[2::3], []]):
        df = spark.createDataFrame([*batch, (None, 3)], "src long, dst long")
        state.add(df, i)
        if i == 1:
            # a batch that comes again changes nothing
            StreamingComponents(spark, f"file://{tmp_path}/state", compact).add(df, i)
    assert pairs(state.labels(), "id", "component") == want


def test_only_older_components_are_merged(spark, tmp_path):
    state = StreamingComponents(spark, f"file://{tmp_path}/state", 0)
    merged = []
    for i, batch in enumerate([[(5, 4), (4, 3), (9, 8)], [(9, 3), (3, 9), (20, 9), (30, 31)], [(3, 1), (31, 31), (1, 0)]]):
        state.add(spark.createDataFrame(batch, "src long, dst long"), i)
        merged.append(pairs(spark.read.schema("old long, component long").parquet(f"file://{tmp_path}/state/merges/batch={i}"), "old", "component"))
    assert merged == [{}, {8: 3}, {8: 0, 3: 0}]
    assert pairs(state.labels(), "id", "component") == {5: 0, 4: 0, 3: 0, 9: 0, 8: 0, 20: 0, 1: 0, 0: 0, 30: 30, 31: 30}


def test_stream_goes_on(spark, tmp_path):
    base = f"file://{tmp_path}"
    for i, rows in enumerate([[(5, 6), (2, 3)], [(6, 3), (9, 8)]]):
        spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.mode("append").parquet(f"{base}/in")
        arcs = spark.readStream.schema("src long, dst long").parquet(f"{base}/in")
        stream_components(arcs, f"{base}/state", f"{base}/offsets").awaitTermination()
        got = pairs(StreamingComponents(spark, f"{base}/state").labels(), "id", "component")
        assert got == [{5: 5, 6: 5, 2: 2, 3: 2}, {5: 2, 6: 2, 2: 2, 3: 2, 8: 8, 9: 8}][i]


# --- recommendation


def test_recommend_many(spark, directed):
    rates = graph(spark, random_arcs(60, 400, 2), False)
    many = recommend_many(directed, rates, directed.vertices())
    got = {}
    for r in many.collect():
        got.setdefault(r.source, []).append((r.rank, r.item, r.votes))
    for source in (1, 5, 33, 70, 69):
        one = [(r.item, r.votes) for r in recommend(directed, rates, source).collect()]
        assert [(i, v) for _, i, v in sorted(got.get(source, []))] == one
    circles = trust_circles(directed, directed.vertices().where("id in (1, 5)"))
    for source in (1, 5):
        assert {r.id for r in circles.where(F.col("source") == source).collect()} == {r.id for r in trust_circle(directed, source).collect()}
    best = recommend(directed, rates, 1)
    assert verify_recommendation(directed, rates, 1, best)
    assert not verify_recommendation(directed, rates, 1, best.withColumn("votes", F.col("votes") + 1))


# --- sinks


@pytest.mark.parametrize("kind", ["gr", "graph", "mtx", "adj", "config", "sg", "wsg"])
def test_sinks(spark, tmp_path, directed, kind):
    path = f"file://{tmp_path}/g.{kind}"
    write_graph(directed, path)
    back = read_graph(spark, path, **({"weighted": True} if kind == "config" else {}))
    weight = (lambda w: 1) if kind == "sg" else (lambda w: w)
    assert {tuple(r) for r in back.edges.collect()} == {(r.src, r.dst, weight(r.weight)) for r in directed.edges.collect()}
    if kind not in ("gr", "graph", "mtx", "adj"):
        assert (tmp_path / f"g.{kind}").is_file() and not [p for p in tmp_path.iterdir() if len(p.name) > 20]


def test_geo_sink(spark, tmp_path, directed):
    path = f"file://{tmp_path}/g.bin"
    places = directed.vertices().where("id <> 5").select("id", (F.col("id") / 100).alias("lat"), (-F.col("id") / 50).alias("lon"))
    write_geo(directed, places, path, vertices_each=16)
    want = {tuple(r) for r in directed.edges.collect()}
    for indexed in (True, False):
        if not indexed:
            spark.read.parquet(index_of(path)).limit(1).write.parquet(f"{path}.other")
            (tmp_path / "g.bin.index").rename(tmp_path / "gone")
        edges, found = read_geo(spark, path)
        assert {tuple(r) for r in edges.collect()} == want
        assert {r.id: (r.lat, r.lon) for r in found.collect()} == {i: (0.0, 0.0) if i == 5 else (i / 100, -i / 50) for i in range(directed.nodes)}


def test_recommend_many_in_ranges_of_ids(spark):
    ids = [0, 1, 5, 32768, 32769, 65536, 65537, 70000]
    clique = Graph.from_tables(spark.createDataFrame([(a, b) for a in ids for b in ids] + [(9, 0), (70000, 80000), (3, 4)], "src long, dst long"))
    rates = Graph.from_tables(spark.createDataFrame([(i, 100 + i % 7, 5) for i in ids] + [(1, 102, 4), (80000, 200, 5), (4, 1, 1)], "src long, dst long, weight long"), weight="weight")
    many = recommend_many(clique, rates, clique.vertices())
    for source in (0, 3, 9, 32769, 70000):
        want = [(r.item, r.votes) for r in recommend(clique, rates, source).collect()]
        assert [(r.item, r.votes) for r in many.where(F.col("source") == source).orderBy("rank").collect()] == want
    bits = circle_bits(clique, clique.vertices().where("id = 9 or id = 32768"))
    assert {(r.source, r.range) for r in bits.collect()} == {(s, n) for s in (9, 32768) for n in (0, 1, 2, 3)}
    assert bits.agg(F.sum(F.bitmap_count("bits"))).head()[0] == 2 * (len(ids) + 1)


def test_propagation_sends_only_what_moved(spark):
    rows = [(i, i + 1) for i in range(12)] + [(100 + i, 200 + i) for i in range(30)] + [(50, 50), (None, 3)]
    edges, trace = spark.createDataFrame(rows, "src long, dst long"), []
    found = {r.id: r.component for r in connected_components(edges, "propagate", trace=trace).collect()}
    assert found == {i: 0 for i in range(13)} | {100 + i + d: 100 + i for i in range(30) for d in (0, 100)}
    assert len(trace) > 9 and trace[-1] == 0 and all(n <= 12 for n in trace[1:])


def test_a_round_of_peeling_takes_few_jobs(spark, mirrored):
    mirrored.by_src()
    trace, group = [], "peel"
    spark.sparkContext.setJobGroup(group, "rounds of peeling")
    cores = kcore(mirrored, "peel", trace=trace)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "")
    assert pairs(cores, "id", "coreness") == pairs(kcore(mirrored), "id", "coreness")
    ks, left = [t["k"] for t in trace], [t["left"] for t in trace]
    assert ks == sorted(ks) and len(ks) > 4 and left == sorted(set(left), reverse=True)
    assert jobs <= 4 * len(trace) + 4


def test_fused_rounds_relax_an_arc_once(spark):
    """The rounds of a fused superstep use each other's exchange: what a round found is not computed again to be written."""
    relaxed = spark.sparkContext.accumulator(0)
    arcs = [(0, i, i) for i in range(1, 11)] + [(i, 10 + i, 1) for i in range(1, 11)]
    fan = Graph.from_tables(spark.createDataFrame(arcs, "src long, dst long, weight long"), weight="weight", nodes=21)

    @F.udf("long")
    def counted(value, weight):
        relaxed.add(1)
        return value + weight

    start = spark.createDataFrame([(0, 0)], "id long, value long")
    found = ordered_process(fan, start, relax=counted, rounds=2)
    # ten arcs in each of two rounds; the second superstep has none left
    assert relaxed.value == 20
    assert pairs(found, "id", "value") == {0: 0} | {i: i for i in range(1, 11)} | {10 + i: i + 1 for i in range(1, 11)}


def test_circles_of_many_are_not_written(spark, monkeypatch):
    r = random.Random(4)
    # most reach nearly all, some a few, some none; items have 1 to 400 fans
    trusts = {(a, r.randrange(1500)) for a in range(1500) for _ in range(30)} | {(a, a + 1) for a in range(1500, 1560)} | {(1600, 0)}
    liked = {(u, int(400 * r.random() ** 3)) for u in range(1300) for _ in range(8)} | {(u, 500) for u in range(0, 1300, 3)} | {(1530, 7)}
    trust = Graph.from_tables(spark.createDataFrame(list(trusts), "src long, dst long")).cache()
    rates = Graph.from_tables(spark.createDataFrame([(u, 2000 + i, 5) for u, i in liked], "src long, dst long, weight long"), weight="weight").cache()
    near, likes = {}, {}
    for a, b in trusts:
        near.setdefault(a, set()).add(b) if a != b else None
    for u, i in liked:
        likes.setdefault(u, []).append(2000 + i)
    want = {}
    for s in range(trust.nodes):
        circle = step = near.get(s, set())
        for _ in range(2):
            step = set().union(*(near.get(v, ()) for v in step))
            circle = circle | step
        votes = Counter(i for u in circle for i in likes.get(u, ()))
        want |= {(s, n + 1): iv for n, iv in enumerate(sorted(votes.items(), key=lambda iv: (-iv[1], -iv[0]))[:5])}
    # circles as rows of their own would be one bitmap for each source and range, and one for each arc on the way
    monkeypatch.setattr(recommend_module, "circle_bits", None)
    for bits in (recommend_module.MATRIX_BITS, 1):
        monkeypatch.setattr(recommend_module, "MATRIX_BITS", bits)
        assert {(row.source, row.rank): (row.item, row.votes) for row in recommend_many(trust, rates, trust.vertices()).collect()} == want


def test_rounds_of_coreness_share_tables_and_send_what_changed(spark):
    path = [(i, i + 1, 1) for i in range(60)]
    hub = [(100, 200 + i, 1) for i in range(300)] + [(200 + i, 201 + i, 1) for i in range(0, 300, 2)]
    clique = [(a, b, 1) for a in range(600, 607) for b in range(a + 1, 607)] + [(606, 100, 1), (60, 600, 1)]
    g = graph(spark, path + hub + clique, True).cache()
    group = "coreness"
    spark.sparkContext.setJobGroup(group, "rounds of coreness")
    cores = kcore(g)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "")
    linked = {i: 1 for i in range(61)} | {100: 2} | {200 + i: 2 for i in range(300)} | {i: 6 for i in range(600, 607)}
    assert pairs(cores, "id", "coreness") == {i: linked.get(i, 0) for i in range(607)}
    # the path loses a vertex a round: some 60 rounds
    assert jobs < 120
