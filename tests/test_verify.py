"""Checks of results: right ones pass, wrong ones do not; and golden values of a small fixed graph."""

import pytest
from pyspark.sql import functions as F

from graphloom import Graph
from graphloom.operators.betweenness import betweenness
from graphloom.operators.bfs import bfs
from graphloom.operators.components import connected_components
from graphloom.operators.kcore import kcore
from graphloom.operators.ordered import sssp
from graphloom.operators.pagerank import pagerank
from graphloom.operators.triangles import triangle_count
from graphloom.operators.verify import verify_betweenness, verify_bfs, verify_components, verify_kcore, verify_pagerank, verify_sssp, verify_triangles
from graphloom.plans.materialize import clean_up, materialize, shared_dir
from graphloom.plans.trials import run_trials

ARCS = [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (2, 3, 8), (3, 0, 1), (5, 4, 3), (4, 5, 3), (3, 4, 7)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([*ARCS, (6, 6, 1)], "src long, dst long, weight long")


def test_directed(rows):
    g = Graph.from_tables(rows, weight="weight")
    tree, dist = bfs(g, 0), sssp(g, 0)
    assert verify_bfs(g, 0, tree) and verify_sssp(g, 0, dist)
    assert not verify_bfs(g, 0, tree.withColumn("depth", F.col("depth") + (F.col("id") == 3).cast("int")))
    assert not verify_bfs(g, 0, tree.where("id <> 3"))
    assert not verify_sssp(g, 0, dist.withColumn("dist", F.col("dist") - (F.col("id") == 3).cast("int")))
    assert not verify_sssp(g, 0, dist.withColumn("dist", F.col("dist") + (F.col("id") == 1).cast("int")))
    assert verify_pagerank(g, pagerank(g, 100, 1e-7)) and not verify_pagerank(g, pagerank(g, 1, 0.0))
    scores = betweenness(g, g.vertices().where("id in (0, 3)"))
    assert verify_betweenness(g, [0, 3], scores) and not verify_betweenness(g, [0, 2], scores)
    labels = g.vertices().join(connected_components(g.edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    assert verify_components(g, labels) and not verify_components(g, labels.withColumn("component", F.lit(0)))


def test_undirected(rows):
    g = Graph.from_tables(rows, weight="weight", mirror=True)
    n = triangle_count(g).head()[0]
    assert n == 4 and verify_triangles(g, n) and not verify_triangles(g, n + 1)
    cores = kcore(g)
    assert verify_kcore(g, cores) and not verify_kcore(g, cores.withColumn("coreness", F.lit(2).cast("long")))


def test_trials_views_and_clean_up(spark, rows):
    g = Graph.from_tables(rows, weight="weight")
    seen = run_trials(g, lambda h: sssp(h, 0), trials=2, verify=lambda d: verify_sssp(g, 0, d))
    assert len(seen["seconds"]) == 2 and seen["right"] and seen["mean"] > 0
    g.create_views("few_vertices", "few_edges")
    assert spark.sql("SELECT count(*) FROM few_vertices v JOIN few_edges e ON e.src = v.id").head()[0] == len(ARCS)
    kept = materialize(rows, "kept")
    path = shared_dir(spark).removeprefix("file://")
    assert kept.count() == 10 and __import__("os").path.isdir(path)
    g.release()
    clean_up(spark)
    assert not __import__("os").path.isdir(path) and not [t for t in spark.catalog.listTables() if t.name.startswith("graphloom_")]
    from graphloom.plans.inputs import forget

    forget()
