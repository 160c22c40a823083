"""Registered graph queries and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.geo import estimates_to, geo_distance
from graphloom.graph import Graph, bucket_number, squish, symmetrize
from graphloom.operators.betweenness import betweenness
from graphloom.operators.bfs import bfs, bfs_all, bfs_stats
from graphloom.operators.components import component_sizes, connected_components
from graphloom.operators.counters import add_counts, merge_counts, pack, reduce_values, scan, summary, top_keys
from graphloom.operators.frontier import edge_map, vertex_filter, vertex_map
from graphloom.operators.kcore import kcore, kcore_stats
from graphloom.operators.ordered import astar, ordered_process, ppsp, sssp
from graphloom.operators.pagerank import pagerank, top_scores
from graphloom.operators.recommend import recommend, recommend_many, trust_circle
from graphloom.operators.triangles import triangle_count
from graphloom.plans.inputs import CHAIN, ORDER, RATE, TRUST, chain_graph, order_graph, rate_graph, trust_graph
from graphloom.plans.materialize import shared_dir
from graphloom.sources.binary import read_geo
from graphloom.sources.generators import kronecker, random_weights, uniform
from graphloom.sources.readers import read_graph
from graphloom.sources.writers import write_geo, write_graph
from graphloom.streaming.components import StreamingComponents, stream_components

Query = Callable[[SparkSession, str], DataFrame]

#: Vertices that the single-source queries start from and end in.
SOURCE, DEST, CHAIN_HEAD, TRUST_SOURCE, TRUST_DEST = 7, 42, 8, 5, 77


def _whole_labels(spark: SparkSession, sf_dir: str, strategy: str = "contract") -> DataFrame:
    g = chain_graph(spark, sf_dir)
    found = connected_components(g.edges, strategy)
    return g.vertices().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _coordinates(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id", (F.col("id") % 180 / 180.0).alias("lat"), (F.col("id") % 360 / 360.0).alias("lon"))


#: Centimetres in a unit of way and estimate in the A* query.
GEO_UNIT = 10_000_000


def _laid_out(g: Graph, places: DataFrame) -> DataFrame:
    """Arcs as long as their weight and the distance of their ends, in whole units, rounded up."""
    a, b = (places.select(F.col("id").alias(end), F.col("lat").alias(f"lat_{end}"), F.col("lon").alias(f"lon_{end}")) for end in ("src", "dst"))
    way = F.ceil(geo_distance(F.col("lat_src"), F.col("lon_src"), F.col("lat_dst"), F.col("lon_dst")) / GEO_UNIT)
    return g.edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("weight") + way).cast("long").alias("weight"))


def _astar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A* on the order graph laid out on a globe: the way along an arc is its weight and the distance of its ends.

    Distances in whole units are rounded up on arcs and down in estimates, so no estimate exceeds the way.
    """
    g = order_graph(spark, sf_dir, True)
    places = _coordinates(spark, g.nodes)
    laid = Graph(_laid_out(g, places), g.nodes, False)
    hints = estimates_to(places, DEST).select("id", F.expr(f"hint div {GEO_UNIT}").alias("hint"))
    return astar(laid, SOURCE, DEST, hints, delta=64)


def _through(kind: str, mirror: bool = False) -> Query:
    """The trust graph (weights 1 + (src + 2 dst) % 7) written in a format and read again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = trust_graph(spark, sf_dir, mirror)
        edges = g.edges.select("src", "dst", (F.lit(1) + (F.col("src") + F.col("dst") * (1 if mirror else 2)) % 7).cast("long").alias("weight"))
        g = Graph(edges, g.nodes, g.directed)
        path = f"{shared_dir(spark)}/format-{uuid.uuid4().hex}.{kind}"
        if kind == "bin":
            write_geo(g, _coordinates(spark, g.nodes), path, 64)
        else:
            write_graph(g, path)
        return read_graph(spark, path, **({"weighted": True} if kind == "config" else {})).edges

    return run


def _astar_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A* over a geo file and the coordinates that it holds: the trust graph on a globe, written and read again."""
    g = trust_graph(spark, sf_dir, True)
    places = _coordinates(spark, g.nodes)
    path = f"{shared_dir(spark)}/places-{uuid.uuid4().hex}.bin"
    write_geo(Graph(_laid_out(g, places).select("src", "dst", (F.col("weight") * GEO_UNIT).alias("weight")), g.nodes, False), places, path, 64)
    edges, found = read_geo(spark, path)
    hints = estimates_to(found, TRUST_DEST).select("id", F.expr(f"hint div {GEO_UNIT} * {GEO_UNIT}").alias("hint"))
    return astar(Graph(edges, g.nodes, False), TRUST_SOURCE, TRUST_DEST, hints)


def _directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the direction-switching search chose, superstep by superstep."""
    trace: list[dict] = []
    bfs(order_graph(spark, sf_dir, True), SOURCE, "hybrid", trace=trace)
    return spark.createDataFrame([(r["depth"], r["direction"], r["size"], r["arcs"], r["unseen"]) for r in trace], "depth long, direction string, size long, arcs long, unseen long")


def _within(spark: SparkSession, sf_dir: str, limit: int = 6) -> DataFrame:
    """Vertices no farther than ``limit``: ordered processing with a stop and a source filter of its own."""
    g = order_graph(spark, sf_dir, True)
    start = g.vertices().where(F.col("id") == SOURCE).select("id", F.lit(0).cast("long").alias("value"))
    found = ordered_process(g, start, delta=2, stop=lambda p: p.low > limit, extend=lambda p: F.col("key") < limit)
    return found.where(F.col("value") <= limit)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the chain graph, whose arcs arrive in batches of a file each."""
    base = f"{shared_dir(spark).rpartition('/')[0]}/stream-{uuid.uuid4().hex}"
    chain_graph(spark, sf_dir).edges.select("src", "dst").repartition(4).write.parquet(f"{base}/arcs")
    arcs = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(f"{base}/arcs")
    stream_components(arcs, f"{base}/labels", f"{base}/offsets", compact=3).awaitTermination()
    return StreamingComponents(spark, f"{base}/labels").labels()


def _weights_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random weights: how many arcs, how many within 1 .. 255, how many like their mirror, and whether they vary."""
    edges = random_weights(order_graph(spark, sf_dir, True)).edges
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("other"))
    return edges.join(back, ["src", "dst"]).agg(
        F.count(F.lit(1)).alias("arcs"), F.count_if(F.col("weight").between(1, 255)).alias("within"), F.count_if(F.col("weight") == F.col("other")).alias("alike"), (F.countDistinct("weight") > 100).alias("varied")
    )


def _sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-step neighbourhoods in SQL over a graph's views.

    Lists of neighbours travel to the first vertex and are opened there, in partitions of some two million pairs, so that pairs
    are neither exchanged nor spilled.
    """
    g = trust_graph(spark, sf_dir)
    g.create_views("trust_vertices", "trust_edges")
    n = bucket_number(spark, g.arcs() * g.arcs() // max(g.nodes, 1))
    return spark.sql(f"""
        WITH met AS (SELECT /*+ REPARTITION({n}, id) */ v.id, ends FROM trust_vertices v LEFT JOIN trust_edges a ON a.src = v.id
          LEFT JOIN (SELECT src, collect_list(dst) AS ends FROM trust_edges GROUP BY src) b ON b.src = a.dst)
        SELECT id, count(DISTINCT far) AS within_two FROM met LATERAL VIEW OUTER explode(ends) AS far GROUP BY id""")


def _bc(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trust_graph(spark, sf_dir)
    return betweenness(g, g.vertices().where("id in (1, 2, 3, 5)")).select("id", F.round("score", 6).alias("score"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank(trust_graph(spark, sf_dir), 20, 0.0).select("id", F.round("score", 6).alias("score"))


def _raw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_graph(spark, sf_dir).edges


def queries() -> dict[str, Query]:
    return {
        "squish_edges": lambda s, d: squish(_raw_order(s, d)),
        "symmetrize_edges": lambda s, d: squish(symmetrize(_raw_order(s, d))),
        "graph_stats": lambda s, d: order_graph(s, d, True).stats().withColumn("graph", F.lit("order")).unionByName(chain_graph(s, d).stats().withColumn("graph", F.lit("chain"))),
        "degrees_out": lambda s, d: order_graph(s, d).out_degrees(),
        "degrees_in": lambda s, d: order_graph(s, d).in_degrees(),
        "vertex_offsets": lambda s, d: order_graph(s, d).vertex_offsets(),
        "relabel_by_degree": lambda s, d: order_graph(s, d, True).degree_ranks(),
        "relabeled_edges": lambda s, d: order_graph(s, d, True).relabel_by_degree().edges,
        "transpose_edges": lambda s, d: trust_graph(s, d).reverse().edges,
        "largest_node": lambda s, d: order_graph(s, d).largest_ids(),
        "adjacency_lists": lambda s, d: trust_graph(s, d).adjacency_lists().select("src", F.concat_ws(",", F.transform("neighbors", lambda x: x.cast("string"))).alias("neighbors")),
        "topk_degree": lambda s, d: order_graph(s, d, True).out_degrees().orderBy(F.desc("degree"), F.desc("id")).limit(10),
        "degree_histogram": lambda s, d: add_counts(order_graph(s, d, True).out_degrees().withColumnRenamed("degree", "key")),
        "degree_summary": lambda s, d: summary(order_graph(s, d, True).out_degrees(), "degree"),
        "counter_topk": lambda s, d: top_keys(add_counts(_raw_order(s, d).withColumnRenamed("dst", "key"), amount=F.col("weight")), 5),
        "prefix_scan": lambda s, d: scan(order_graph(s, d).in_degrees().withColumnRenamed("degree", "value"), inclusive=True),
        "backward_scan": lambda s, d: scan(order_graph(s, d).in_degrees().withColumnRenamed("degree", "value"), backward=True),
        "pack_index": lambda s, d: pack(order_graph(s, d).out_degrees(), F.col("degree") > 0),
        "bfs_depth": lambda s, d: bfs(order_graph(s, d, True), SOURCE).select("id", "depth"),
        "bfs_bottom_up": lambda s, d: bfs(order_graph(s, d, True), SOURCE, "bottom_up").select("id", "depth"),
        "bfs_parent": lambda s, d: bfs_all(trust_graph(s, d), TRUST_SOURCE).select("id", "parent"),
        "bfs_stats": lambda s, d: bfs_stats(g := order_graph(s, d, True), bfs(g, SOURCE)),
        "sssp_dist": lambda s, d: sssp(order_graph(s, d, True), SOURCE),
        "sssp_delta": lambda s, d: sssp(order_graph(s, d, True), SOURCE, delta=8, merge_buckets=2),
        "sssp_chain": lambda s, d: sssp(chain_graph(s, d), CHAIN_HEAD, rounds="auto"),
        "sssp_reached": lambda s, d: sssp(order_graph(s, d, True), SOURCE).agg(F.count("dist").alias("reached"), F.max("dist").alias("farthest")),
        "ppsp_dist": lambda s, d: ppsp(order_graph(s, d, True), SOURCE, DEST),
        "astar_dist": _astar,
        "ordered_process_min": lambda s, d: ordered_process(g := order_graph(s, d, True), g.vertices().where(f"id in ({SOURCE}, {DEST})").select("id", F.lit(0).cast("long").alias("value")), relax=lambda v, w: F.greatest(v, w)),
        "geo_distance": lambda s, d: _coordinates(s, 1000).select("id", F.round(geo_distance(F.col("lat"), F.col("lon"), F.lit(0.5), F.lit(0.25)) / 1000).cast("long").alias("metres10")),
        "pagerank_20": _ranked,
        "pagerank_top5": lambda s, d: top_scores(_ranked(s, d)),
        "cc_label": _whole_labels,
        "cc_propagate": lambda s, d: _whole_labels(s, d, "propagate"),
        "cc_sizes_top5": lambda s, d: component_sizes(_whole_labels(s, d)).orderBy(F.desc("size"), F.desc("component")).limit(5),
        "cc_count": lambda s, d: _whole_labels(s, d).agg(F.countDistinct("component").alias("components")),
        "bc_scores": _bc,
        "triangle_count": lambda s, d: triangle_count(order_graph(s, d, True)),
        "triangle_count_intersect": lambda s, d: triangle_count(trust_graph(s, d, True), "intersect", "auto"),
        "triangle_count_segments": lambda s, d: triangle_count(order_graph(s, d, True), "segments", width=256),
        "segment_arcs": lambda s, d: order_graph(s, d, True).segments(256).groupBy("segment").agg(F.count(F.lit(1)).alias("arcs"), F.countDistinct("src").alias("sources")),
        "kcore": lambda s, d: kcore(order_graph(s, d, True)),
        "kcore_max_sum": lambda s, d: kcore_stats(kcore(order_graph(s, d, True))),
        "trust_circle": lambda s, d: trust_circle(trust_graph(s, d), TRUST_SOURCE),
        "recommend_top5": lambda s, d: recommend(trust_graph(s, d), rate_graph(s, d), TRUST_SOURCE),
        "edge_map": lambda s, d: edge_map(g := trust_graph(s, d), g.vertices(), combine=F.sum),
        "vertex_filter": lambda s, d: vertex_filter(vertex_map(trust_graph(s, d).out_degrees(), even=F.col("degree") % 2 == 0), F.col("even")),
        "bfs_hybrid": lambda s, d: bfs(order_graph(s, d, True), SOURCE, "hybrid"),
        "bfs_directions": _directions,
        "edge_map_auto": lambda s, d: edge_map(g := order_graph(s, d, True), vertex_filter(g.out_degrees(), F.col("degree") % 2 == 0), cond=vertex_filter(g.out_degrees(), F.col("degree") % 2 == 1), direction="auto"),
        "within_distance": _within,
        "cc_sampled": lambda s, d: _whole_labels(s, d, "sampled"),
        "cc_streamed": _streamed,
        "recommend_all": lambda s, d: recommend_many(g := trust_graph(s, d), rate_graph(s, d), g.vertices()),
        "astar_geo_file": _astar_file,
        "sssp_fused": lambda s, d: sssp(order_graph(s, d, True), SOURCE, rounds=2),
        "ppsp_fused": lambda s, d: ppsp(order_graph(s, d, True), SOURCE, DEST, delta=8, rounds=2),
        "kcore_peel": lambda s, d: kcore(trust_graph(s, d, True), "peel"),
        "recommend_padded": lambda s, d: recommend(trust_graph(s, d), rate_graph(s, d), TRUST_SOURCE, above=5, pad=True),
        "counter_merge": lambda s, d: merge_counts(*(add_counts(trust_graph(s, d).edges.withColumnRenamed(end, "key")) for end in ("src", "dst"))),
        "counter_reduce": lambda s, d: reduce_values(order_graph(s, d).in_degrees().withColumnRenamed("degree", "value")),
        "edge_map_cond": lambda s, d: edge_map(g := trust_graph(s, d), g.vertices(), update=lambda met: met["weight"] + met["id"], combine=F.max, cond=vertex_filter(g.out_degrees(), F.col("degree") % 2 == 0)),
        "sql_views": _sql_views,
        **{f"format_{kind}": _through(kind) for kind in ("el", "wel", "gr", "graph", "mtx", "adj", "config", "bin", "sg", "wsg", "parquet")},
        "format_wsg_mirrored": _through("wsg", True),
        "gen_kronecker": lambda s, d: add_counts(kronecker(s, 10).out_degrees().withColumnRenamed("degree", "key")),
        "gen_uniform": lambda s, d: add_counts(uniform(s, 10).out_degrees().withColumnRenamed("degree", "key")),
        "gen_weights": _weights_kept,
    }


def _ordered(source: str, relaxed: str, edges: str = "u", rounds: int = 40) -> str:
    """Rounds of relaxation from the ids in ``source``; ``relaxed`` is the new value from r.value and e.weight."""
    return f"""
r(k, id, value) AS (SELECT 0, id, CAST(0 AS BIGINT) FROM v WHERE id IN ({source})
  UNION ALL SELECT k + 1, id, min(value) FROM (SELECT k, e.dst AS id, {relaxed} AS value FROM r JOIN {edges} e ON r.id = e.src UNION ALL SELECT k, id, value FROM r) WHERE k < {rounds} GROUP BY k, id),
best AS (SELECT id, value FROM r WHERE k = {rounds})"""


_SSSP = _ordered(str(SOURCE), "r.value + e.weight", rounds=24)
_BFS = _ordered(str(SOURCE), "r.value + 1", rounds=10)
_LABELS = """
pairs AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
l(k, id, c) AS (SELECT 0, id, id FROM v
  UNION ALL SELECT k + 1, id, min(c) FROM (SELECT k, b.dst AS id, c FROM l JOIN pairs b ON l.id = b.src UNION ALL SELECT k, id, c FROM l) WHERE k < 40 GROUP BY k, id),
label AS (SELECT id, c AS component FROM l WHERE k = 40)"""
_RANK = """
deg AS (SELECT src, count(*) AS d FROM g GROUP BY src),
p(k, id, score) AS (SELECT 0, id, CAST(1.0 AS DOUBLE) / n FROM v, n
  UNION ALL SELECT k + 1, id, max(0.15 / n) + 0.85 * sum(part) FROM (
    SELECT k, g.dst AS id, score / deg.d AS part FROM p JOIN g ON p.id = g.src JOIN deg ON deg.src = g.src UNION ALL SELECT k, id, CAST(0.0 AS DOUBLE) FROM p), n WHERE k < 20 GROUP BY k, id),
ranked AS (SELECT id, round(score, 6) AS score FROM p WHERE k = 20)"""
_CORE = """
c(k, id, core) AS (SELECT 0, v.id, count(u.dst) FROM v LEFT JOIN u ON v.id = u.src GROUP BY v.id
  UNION ALL SELECT k + 1, id, coalesce(list_max(list_transform(list(x ORDER BY x DESC), lambda y, i: least(y, i))), 0) FROM (
    SELECT c.k, c.id, m.core AS x FROM c LEFT JOIN u ON c.id = u.src LEFT JOIN c m ON m.id = u.dst) WHERE k < 40 GROUP BY k, id),
core AS (SELECT id, core AS coreness FROM c WHERE k = 40)"""
_DEGREES = "deg AS (SELECT v.id, count(u.dst) AS degree FROM v LEFT JOIN u ON v.id = u.src GROUP BY v.id)"
_IN = "d AS (SELECT v.id, count(g.src) AS value FROM v LEFT JOIN g ON v.id = g.dst GROUP BY v.id)"
_OUT = "d AS (SELECT v.id, count(g.dst) AS value FROM v LEFT JOIN g ON v.id = g.src GROUP BY v.id)"
_CIRCLE = f"""
h1 AS (SELECT DISTINCT dst AS id FROM g WHERE src = {TRUST_SOURCE}), h2 AS (SELECT DISTINCT dst AS id FROM g JOIN h1 ON src = id), h3 AS (SELECT DISTINCT dst AS id FROM g JOIN h2 ON src = id),
circle AS (SELECT id FROM h1 UNION SELECT id FROM h2 UNION SELECT id FROM h3)"""


_BC_DEPTH = 16
_BC_SOURCES = "1, 2, 3, 5"
#: Depths by rounds that carry every pair, then path counts level by level, then shares from the deepest level up.
_BC = f"""
dr(k, s, id, value) AS (SELECT 0, id, id, CAST(0 AS BIGINT) FROM v WHERE id IN ({_BC_SOURCES})
  UNION ALL SELECT k + 1, s, id, min(value) FROM (SELECT k, s, e.dst AS id, r.value + 1 AS value FROM dr r JOIN g e ON r.id = e.src UNION ALL SELECT k, s, id, value FROM dr) WHERE k < {_BC_DEPTH} GROUP BY k, s, id),
dep AS (SELECT s, id, value FROM dr WHERE k = {_BC_DEPTH}),
pc(k, s, id, paths) AS (SELECT CAST(0 AS BIGINT), id, id, CAST(1 AS DOUBLE) FROM v WHERE id IN ({_BC_SOURCES})
  UNION ALL SELECT k + 1, pc.s, g.dst, sum(paths) FROM pc JOIN g ON g.src = pc.id JOIN dep ON dep.s = pc.s AND dep.id = g.dst AND dep.value = k + 1 GROUP BY k, pc.s, g.dst),
paths AS MATERIALIZED (SELECT k, s, id, paths FROM pc),
""" + ",\n".join(
    [f"sh{_BC_DEPTH} AS MATERIALIZED (SELECT s, id, paths, CAST(0 AS DOUBLE) AS share FROM paths WHERE k = {_BC_DEPTH})"]
    + [
        f"sh{k} AS MATERIALIZED (SELECT p.s, p.id, p.paths, coalesce(sum(p.paths / c.paths * (1 + c.share)), 0) AS share FROM paths p LEFT JOIN (SELECT g.src, c.s, c.paths, c.share FROM g JOIN sh{k + 1} c ON c.id = g.dst) c ON c.src = p.id AND c.s = p.s WHERE p.k = {k} GROUP BY p.s, p.id, p.paths)"
        for k in range(_BC_DEPTH - 1, -1, -1)
    ]
)
_BC += ",\ntotal AS (SELECT id, sum(share) AS share FROM (" + " UNION ALL ".join(f"SELECT id, share FROM sh{k}" for k in range(_BC_DEPTH + 1)) + ") GROUP BY id)"
#: Sizes and arcs of the levels of a search, and the direction each superstep takes from them.
_DIRECTIONS = """
level AS (SELECT k, size, arcs, (SELECT count(*) FROM u) - sum(arcs) OVER (ORDER BY k) AS unseen
  FROM (SELECT best.value AS k, count(DISTINCT best.id) AS size, count(u.dst) AS arcs FROM best LEFT JOIN u ON u.src = best.id GROUP BY best.value)),
d(k, pulls, size) AS (SELECT CAST(-1 AS BIGINT), false, CAST(0 AS BIGINT)
  UNION ALL SELECT level.k, CASE WHEN d.pulls THEN NOT (level.size < d.size AND level.size * 18 < n.n) ELSE level.arcs * 15 > level.unseen END, level.size FROM d JOIN level ON level.k = d.k + 1, n)"""
_GEO = f"""
place AS (SELECT id, id % 180 / 180.0::DOUBLE AS lat, id % 360 / 360.0::DOUBLE AS lon FROM v),
laid AS (SELECT src, dst, weight + CAST(ceil(2 * atan2(sqrt(h), sqrt(1 - h)) * 637100000.0::DOUBLE / {GEO_UNIT}) AS BIGINT) AS weight FROM (
  SELECT src, dst, weight, pow(sin((b.lat - a.lat) * 0.5::DOUBLE), 2) + pow(sin((b.lon - a.lon) * 0.5::DOUBLE), 2) * cos(a.lat) * cos(b.lat) AS h FROM u JOIN place a ON a.id = src JOIN place b ON b.id = dst))"""


def _format_sql(weight: str) -> str:
    return f"WITH {TRUST} SELECT src, dst, CAST({weight} AS BIGINT) AS weight FROM g"


def _stats(name: str, edges: str, per_edge: int, graph: str) -> str:
    return f"(WITH {graph} SELECT n AS nodes, m AS edges, {'true' if per_edge == 1 else 'false'} AS directed, m // n AS degree, '{name}' AS graph FROM n, (SELECT count(*) // {per_edge} AS m FROM {edges}))"


def oracle_sql() -> dict[str, str]:
    return {
        "squish_edges": f"WITH {ORDER} SELECT src, dst, weight FROM g",
        "symmetrize_edges": f"WITH {ORDER} SELECT src, dst, weight FROM u",
        "graph_stats": f"SELECT * FROM {_stats('order', 'u', 2, ORDER)} UNION ALL SELECT * FROM {_stats('chain', 'g', 1, CHAIN)}",
        "degrees_out": f"WITH {ORDER}, {_OUT} SELECT id, value AS degree FROM d",
        "degrees_in": f"WITH {ORDER}, {_IN} SELECT id, value AS degree FROM d",
        "vertex_offsets": f'WITH {ORDER}, {_OUT} SELECT id, CAST(coalesce(sum(value) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM d',
        "relabel_by_degree": f"WITH {ORDER}, {_DEGREES} SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id DESC) - 1 AS rank FROM deg",
        "relabeled_edges": f"WITH {ORDER}, {_DEGREES}, k AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY degree DESC, id DESC) - 1 AS rank FROM deg) SELECT a.rank AS src, b.rank AS dst, weight FROM u JOIN k a ON a.id = u.src JOIN k b ON b.id = u.dst",
        "transpose_edges": f"WITH {TRUST} SELECT dst AS src, src AS dst, weight FROM g",
        "largest_node": f"WITH {ORDER} SELECT max(src) AS max_src, max(dst) AS max_dst FROM g",
        "adjacency_lists": f"WITH {TRUST} SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM g GROUP BY src",
        "topk_degree": f"WITH {ORDER}, {_DEGREES} SELECT id, degree FROM deg ORDER BY degree DESC, id DESC LIMIT 10",
        "degree_histogram": f"WITH {ORDER}, {_DEGREES} SELECT degree AS key, count(*) AS value FROM deg GROUP BY degree",
        "degree_summary": f"WITH {ORDER}, {_DEGREES} SELECT avg(degree) AS mean, quantile_cont(degree, 0.5) AS median, min(degree) AS least FROM deg",
        "counter_topk": f"WITH {ORDER} SELECT dst AS key, CAST(sum(weight) AS BIGINT) AS value FROM g GROUP BY dst ORDER BY value DESC, key DESC LIMIT 5",
        "prefix_scan": f"WITH {ORDER}, {_IN} SELECT id, value, CAST(sum(value) OVER (ORDER BY id) AS BIGINT) AS before FROM d",
        "backward_scan": f"WITH {ORDER}, {_IN} SELECT id, value, CAST(coalesce(sum(value) OVER (ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d",
        "pack_index": f"WITH {ORDER}, {_OUT} SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM d WHERE value > 0",
        "bfs_depth": f"WITH RECURSIVE {ORDER}, {_BFS} SELECT id, value AS depth FROM best",
        "bfs_bottom_up": f"WITH RECURSIVE {ORDER}, {_BFS} SELECT id, value AS depth FROM best",
        "bfs_parent": f"WITH RECURSIVE {TRUST}, {_ordered(str(TRUST_SOURCE), 'r.value + 1', 'g', 12)}, p AS (SELECT b.id, min(a.id) AS parent FROM best b JOIN g ON g.dst = b.id JOIN best a ON a.id = g.src AND a.value = b.value - 1 GROUP BY b.id) "
        f"SELECT v.id, CASE WHEN v.id = {TRUST_SOURCE} THEN {TRUST_SOURCE} ELSE coalesce(parent, -1) END AS parent FROM v LEFT JOIN p ON p.id = v.id",
        "bfs_stats": f"WITH RECURSIVE {ORDER}, {_BFS} SELECT count(DISTINCT best.id) AS reached, count(u.dst) AS arcs FROM best LEFT JOIN u ON u.src = best.id",
        "sssp_dist": f"WITH RECURSIVE {ORDER}, {_SSSP} SELECT id, value AS dist FROM best",
        "sssp_delta": f"WITH RECURSIVE {ORDER}, {_SSSP} SELECT id, value AS dist FROM best",
        "sssp_chain": f"WITH RECURSIVE {CHAIN}, {_ordered(str(CHAIN_HEAD), 'r.value + e.weight', 'g', 60)} SELECT id, value AS dist FROM best",
        "sssp_reached": f"WITH RECURSIVE {ORDER}, {_SSSP} SELECT count(*) AS reached, max(value) AS farthest FROM best",
        "ppsp_dist": f"WITH RECURSIVE {ORDER}, {_SSSP} SELECT id, value AS dist FROM best WHERE id = {DEST}",
        "astar_dist": f"WITH RECURSIVE {ORDER}, {_GEO}, {_ordered(str(SOURCE), 'r.value + e.weight', 'laid', 24)} SELECT id, value AS dist FROM best WHERE id = {DEST}",
        "bfs_hybrid": f"WITH RECURSIVE {ORDER}, {_BFS}, p AS (SELECT b.id, min(a.id) AS parent FROM best b JOIN u ON u.dst = b.id JOIN best a ON a.id = u.src AND a.value = b.value - 1 GROUP BY b.id) "
        f"SELECT best.id, value AS depth, coalesce(parent, best.id) AS parent FROM best LEFT JOIN p ON p.id = best.id",
        "bfs_directions": f"WITH RECURSIVE {ORDER}, {_BFS}, {_DIRECTIONS} SELECT level.k + 1 AS depth, CASE WHEN pulls THEN 'bottom_up' ELSE 'top_down' END AS direction, level.size, arcs, CAST(unseen AS BIGINT) AS unseen FROM level JOIN d ON d.k = level.k",
        "edge_map_auto": f"WITH {ORDER}, {_DEGREES} SELECT u.dst AS id, min(u.src) AS value FROM u JOIN deg a ON a.id = u.src JOIN deg b ON b.id = u.dst WHERE a.degree % 2 = 0 AND b.degree % 2 = 1 GROUP BY u.dst",
        "within_distance": f"WITH RECURSIVE {ORDER}, {_SSSP} SELECT id, value FROM best WHERE value <= 6",
        "cc_sampled": f"WITH RECURSIVE {CHAIN}, {_LABELS} SELECT id, component FROM label",
        "cc_streamed": f"WITH RECURSIVE {CHAIN}, {_LABELS} SELECT id, component FROM label WHERE id IN (SELECT src FROM g UNION SELECT dst FROM g)",
        "recommend_all": f"WITH {TRUST}, {RATE}, h1 AS (SELECT DISTINCT src AS source, dst AS id FROM g), h2 AS (SELECT DISTINCT source, dst AS id FROM h1 JOIN g ON src = id), h3 AS (SELECT DISTINCT source, dst AS id FROM h2 JOIN g ON src = id), "
        "circle AS (SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3), votes AS (SELECT source, rate.dst AS item, count(*) AS votes FROM circle JOIN rate ON rate.src = circle.id, rn WHERE circle.id < rn.n AND rate.weight > 3 GROUP BY source, rate.dst) "
        "SELECT source, item, votes, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY votes DESC, item DESC) AS rank FROM votes) WHERE rank <= 5",
        "astar_geo_file": f"WITH RECURSIVE {TRUST}, {_GEO}, {_ordered(str(TRUST_SOURCE), 'r.value + e.weight', 'laid', 24)} SELECT id, value * {GEO_UNIT} AS dist FROM best WHERE id = {TRUST_DEST}",
        "sssp_fused": f"WITH RECURSIVE {ORDER}, {_SSSP} SELECT id, value AS dist FROM best",
        "ppsp_fused": f"WITH RECURSIVE {ORDER}, {_SSSP} SELECT id, value AS dist FROM best WHERE id = {DEST}",
        "kcore_peel": f"WITH RECURSIVE {TRUST}, {_CORE} SELECT id, coreness FROM core",
        "bc_scores": f"WITH RECURSIVE {TRUST}, {_BC} SELECT v.id, round(coalesce(share, 0) / (SELECT max(share) FROM total), 6) AS score FROM v LEFT JOIN total ON total.id = v.id",
        "recommend_padded": f"WITH {TRUST}, {RATE}, {_CIRCLE}, best AS (SELECT rate.dst AS item, count(*) AS votes FROM circle JOIN rate ON rate.src = circle.id, rn WHERE circle.id < rn.n AND rate.weight > 5 GROUP BY rate.dst), "
        "filled AS (SELECT * FROM best UNION ALL SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM range(5)) SELECT item, votes FROM filled ORDER BY votes DESC, item DESC LIMIT 5",
        "counter_merge": f"WITH {TRUST} SELECT key, count(*) AS value FROM (SELECT src AS key FROM g UNION ALL SELECT dst FROM g) GROUP BY key",
        "counter_reduce": f"WITH {ORDER}, {_IN} SELECT CAST(sum(value) AS BIGINT) AS sum, min(value) AS least, max(value) AS most, count(value) AS n FROM d",
        "edge_map_cond": f"WITH {TRUST}, {_OUT} SELECT dst AS id, max(weight + src) AS value FROM g JOIN d ON d.id = g.dst WHERE d.value % 2 = 0 GROUP BY dst",
        "sql_views": f"WITH {TRUST} SELECT v.id, count(DISTINCT b.dst) AS within_two FROM v LEFT JOIN g a ON a.src = v.id LEFT JOIN g b ON b.src = a.dst GROUP BY v.id",
        **{f"format_{kind}": _format_sql("1" if kind in ("el", "sg") else "1 + (src + dst * 2) % 7") for kind in ("el", "wel", "gr", "graph", "mtx", "adj", "config", "bin", "sg", "wsg", "parquet")},
        "format_wsg_mirrored": f"WITH {TRUST} SELECT src, dst, CAST(1 + (src + dst) % 7 AS BIGINT) AS weight FROM u",
        "gen_weights": f"WITH {ORDER} SELECT count(*) AS arcs, count(*) AS within, count(*) AS alike, true AS varied FROM u",
        "ordered_process_min": f"WITH RECURSIVE {ORDER}, {_ordered(f'{SOURCE}, {DEST}', 'greatest(r.value, e.weight)')} SELECT id, value FROM best",
        "geo_distance": "WITH p AS (SELECT i AS id, i % 180 / 180.0::DOUBLE AS lat, i % 360 / 360.0::DOUBLE AS lon FROM range(1000) t(i)), "
        "s AS (SELECT id, pow(sin((0.5::DOUBLE - lat) / 2), 2) + pow(sin((0.25::DOUBLE - lon) / 2), 2) * cos(lat) * cos(0.5::DOUBLE) AS s FROM p) SELECT id, CAST(round(2 * atan2(sqrt(s), sqrt(1 - s)) * 637100000.0::DOUBLE / 1000) AS BIGINT) AS metres10 FROM s",
        "pagerank_20": f"WITH RECURSIVE {TRUST}, {_RANK} SELECT id, score FROM ranked",
        "pagerank_top5": f"WITH RECURSIVE {TRUST}, {_RANK} SELECT id, score FROM ranked ORDER BY score DESC, id DESC LIMIT 5",
        "cc_label": f"WITH RECURSIVE {CHAIN}, {_LABELS} SELECT id, component FROM label",
        "cc_propagate": f"WITH RECURSIVE {CHAIN}, {_LABELS} SELECT id, component FROM label",
        "cc_sizes_top5": f"WITH RECURSIVE {CHAIN}, {_LABELS} SELECT component, count(*) AS size FROM label GROUP BY component ORDER BY size DESC, component DESC LIMIT 5",
        "cc_count": f"WITH RECURSIVE {CHAIN}, {_LABELS} SELECT count(DISTINCT component) AS components FROM label",
        "triangle_count": f"WITH {ORDER} SELECT count(*) AS triangles FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst",
        "triangle_count_segments": f"WITH {ORDER} SELECT count(*) AS triangles FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst",
        "segment_arcs": f"WITH {ORDER} SELECT dst // 256 AS segment, count(*) AS arcs, count(DISTINCT src) AS sources FROM u GROUP BY 1",
        "triangle_count_intersect": f"WITH {TRUST} SELECT count(*) AS triangles FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst",
        "kcore": f"WITH RECURSIVE {ORDER}, {_CORE} SELECT id, coreness FROM core",
        "kcore_max_sum": f"WITH RECURSIVE {ORDER}, {_CORE} SELECT max(coreness) AS max_coreness, CAST(sum(coreness) AS BIGINT) AS sum_coreness FROM core",
        "trust_circle": f"WITH {TRUST}, {_CIRCLE} SELECT id FROM circle",
        "recommend_top5": f"WITH {TRUST}, {RATE}, {_CIRCLE} SELECT rate.dst AS item, count(*) AS votes FROM circle JOIN rate ON rate.src = circle.id, rn WHERE circle.id < rn.n AND rate.weight > 3 GROUP BY rate.dst ORDER BY votes DESC, item DESC LIMIT 5",
        "edge_map": f"WITH {TRUST} SELECT dst AS id, CAST(sum(src) AS BIGINT) AS value FROM g GROUP BY dst",
        "vertex_filter": f"WITH {TRUST}, {_OUT} SELECT id, value AS degree, value % 2 = 0 AS even FROM d WHERE value % 2 = 0",
    }
