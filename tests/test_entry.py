"""The driver contract, streaming, and the registered queries with their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from graphloom.operators.counters import add_counts, find, merge_counts, reduce_values, updated_keys
from graphloom.plans import registry
from graphloom.streaming.degrees import streaming_degrees

QUICK = ["squish_edges", "graph_stats", "vertex_offsets", "relabel_by_degree", "bfs_parent", "sssp_chain", "cc_label", "pagerank_20", "triangle_count", "recommend_top5", "backward_scan", "pack_index"]


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_keys():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, sf)
    found = con.execute(registry.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


def test_counters(spark):
    a = add_counts(spark.createDataFrame([(1,), (1,), (2,)], "key long"))
    b = spark.createDataFrame([(2, -1), (3, 4)], "key long, value long")
    both = merge_counts(a, b)
    assert {r.key: r.value for r in both.collect()} == {1: 2, 2: 0, 3: 4}
    assert {r.key for r in updated_keys(both).collect()} == {1, 3}
    assert find(both, 3).head().value == 4
    assert reduce_values(both).head().asDict() == {"sum": 6, "least": 0, "most": 4, "n": 3}


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    q = streaming_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.degree for r in spark.table("deg").collect()} == {1: 2, 2: 1}
